"""A longitudinal store of captures in Parquet.

Captures are hashed into buckets, and a bucket's rows lie sorted by capture, so neither many small
captures nor one with a third of all rows shape the files: the first share them, the second fills
several.  An ingest writes what it brings and nothing else; a manifest makes it current at once.  Of
a capture that was ingested again its latest version counts, which the table of captures, one row per
capture and version, tells without a look at the events.  A bucket with ``PIECES`` versions is put
together, and files that neither this manifest nor the one before names are removed.

Reading one capture opens the one version of its bucket that holds it, and there only the row groups
that can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.session import broadcast_if_small, drop_path, estimated_bytes, source_bytes
from seqloom.sources.manifest import Manifest

#: Buckets of a new store at least, and the bytes of its first ingest that one bucket takes.
BUCKETS, BUCKET_BYTES = 64, 256 << 20
#: What Catalyst says of sources it can't weigh is this or more.
UNKNOWN_BYTES = 1 << 60
#: Rows of a capture that are written by one task.
ROWS = 2_000_000
#: Versions a bucket may lie in before they are put together.
PIECES = 8


class CaptureStore:
    """Events and a summary of each capture under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.asked = spark, path.rstrip("/"), buckets
        self._manifest = Manifest(spark, self.path)

    def _state(self) -> dict:
        return self._manifest.read({"version": 0, "n_buckets": self.asked or BUCKETS, "buckets": {}, "before": {}})

    @staticmethod
    def _bucket(capture: Column, n_buckets: int) -> Column:
        return F.pmod(F.xxhash64(capture), F.lit(n_buckets)).cast("int")

    def _paths(self, table: str, buckets: dict[str, list[int]]) -> list[str]:
        return [f"{self.path}/{table}/v={v}/bucket={b}" for b, versions in buckets.items() for v in versions]

    def _read(self, table: str, buckets: dict[str, list[int]]) -> DataFrame | None:
        """Rows of the buckets with the version ``v`` they were written in."""
        paths = self._paths(table, buckets)
        return self.spark.read.option("basePath", f"{self.path}/{table}").option("mergeSchema", table == "events").parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, table: str, version: int, *spread: Column) -> None:
        rows.repartition("bucket", *spread).sortWithinPartitions("bucket", "capture_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/v={version}")

    @staticmethod
    def _ranked(captures: DataFrame) -> DataFrame:
        return captures.withColumn("_rank", F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("v"))))  # its versions

    def _current(self, buckets: dict[str, list[int]]) -> DataFrame | None:
        """The events of the buckets without those of replaced versions, which hardly ever are many."""
        events = self._read("events", buckets)
        if events is None or all(len(v) == 1 for v in buckets.values()):
            return events
        stale = self._ranked(self._read("captures", buckets)).where("_rank > 1").select("capture_id", "v")
        return events.join(broadcast_if_small(stale), ["capture_id", "v"], "left_anti")

    def ingest(self, events: DataFrame, source_path: str = "") -> None:
        """Write all captures of ``events`` (capture_id, seq, ts_us, ...), replacing what the store has of them.

        Rows without a capture are left out.
        """
        state = self._state()
        if not state["version"] and self.asked is None:
            sources = source_bytes(events)
            size = min(estimated_bytes(events), sources)  # a join's estimate may be the product of its sides
            state["n_buckets"] = BUCKETS if sources >= UNKNOWN_BYTES else max(BUCKETS, -(-size // BUCKET_BYTES))
        version = state["version"] + 1
        rows = events.where("capture_id is not null").withColumn("bucket", self._bucket(F.col("capture_id"), state["n_buckets"]))
        self._write(rows, "events", version, F.floor(F.coalesce("seq", F.lit(0)) / ROWS))
        buckets = {b: list(v) for b, v in state["buckets"].items()}
        touched = [str(b) for b in self._manifest.partitions(f"events/v={version}", "bucket")]
        for b in touched:
            buckets[b] = [*buckets.get(b, []), version]
        if touched:
            written = self._read("events", {b: [version] for b in touched})
            summary = written.groupBy("bucket", "capture_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts_us").alias("t_min_us"), F.max("ts_us").alias("t_max_us"), F.lit(source_path).alias("source_path"))
            self._write(summary, "captures", version)
        full = {b: buckets[b] for b in touched if len(buckets[b]) >= PIECES}
        unnamed = {b: [version] for b in full}
        if full:
            version += 1
            self._write(self._current(full).drop("v"), "events", version, F.floor(F.coalesce("seq", F.lit(0)) / ROWS))
            self._write(self._ranked(self._read("captures", full)).where("_rank = 1").drop("_rank", "v"), "captures", version)
            buckets |= {b: [version] for b in full}
        self._manifest.commit({"version": version, "n_buckets": state["n_buckets"], "buckets": buckets, "before": state["buckets"]})
        for table in ("events", "captures"):  # a reader may still hold the manifest before this one, but none before that
            named = {*self._paths(table, buckets), *self._paths(table, state["buckets"])}
            for path in {*self._paths(table, state["before"]), *self._paths(table, unnamed)} - named:
                drop_path(self.spark, path)

    def captures(self) -> DataFrame:
        """(capture_id, n_events, t_min_us, t_max_us, source_path) by the first event."""
        df = self._read("captures", self._state()["buckets"])
        if df is None:
            return self.spark.createDataFrame([], "capture_id string, n_events bigint, t_min_us bigint, t_max_us bigint, source_path string")
        return self._ranked(df).where("_rank = 1").select("capture_id", "n_events", "t_min_us", "t_max_us", "source_path").orderBy("t_min_us", "capture_id")

    def events(self, capture_id: str | None = None) -> DataFrame | None:
        """All events, or those of one capture; None from a store that holds nothing there."""
        state = self._state()
        if capture_id is None:
            df = self._current(state["buckets"])
            return df if df is None else df.drop("v", "bucket")
        bucket = str(self.spark.range(1).select(self._bucket(F.lit(capture_id), state["n_buckets"])).head()[0])
        known = self._read("captures", {bucket: state["buckets"].get(bucket, [])})
        version = None if known is None else known.where(F.col("capture_id") == capture_id).agg(F.max("v")).head()[0]
        if version is None:
            return None
        return self._read("events", {bucket: [version]}).where(F.col("capture_id") == capture_id).drop("v", "bucket")
