"""Aggregates per period of event time, corrected as late records arrive.

Records arrive in ``seq`` order of their key but happened at ``ts_us``.  A store retains every raw
record, rejected ones too, with the greatest event time its key had reached before it; so whether it
is late follows for any width of period and any cut-off.  Raw records are partitioned by groups of
``PART_US`` of event time, and each such partition has one table of counts.

Each batch is judged against what arrived before: a record is late if the greatest event time before
it is at or after the end of its period, and rejected if it is also more than the cut-off behind.
Its records join the retained ones, the partitions in which it changes a period are recomputed
entirely from these, and a new manifest, put in place by one rename, makes all of them current at
once.  A batch that failed half-way leaves the old manifest, and with it the old tables.

A batch opens what its own partitions hold and one row per key of earlier times: the greatest times
are written anew with each batch, and a partition whose raw records lie in ``PIECES`` places is
rewritten as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.session import drop_path, scratch_path
from seqloom.sources.manifest import Manifest

PERIOD_US, CUTOFF_US = 900_000_000, 7_200_000_000
#: Event time in one partition: six hours.
PART_US = 21_600_000_000
#: Batches in which the raw records of a partition may lie before they are put together.
PIECES = 8

_RAW = "capture_id string, seq bigint, ts_us bigint, high bigint"
_COUNTS = "capture_id string, period_us bigint, n_final bigint, n_late bigint"


def verdict(period_us: int, cutoff_us: int) -> tuple[Column, Column, Column]:
    """(period_us, late, rejected) of a raw record (ts_us, high)."""
    period = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(period_us))
    late = F.coalesce(F.col("high") >= period + F.lit(period_us), F.lit(False))
    return period, late, late & (F.col("high") - F.col("ts_us") > F.lit(cutoff_us))


def period_counts(raw: DataFrame, period_us: int, cutoff_us: int) -> DataFrame:
    """(capture_id, period_us, n_final, n_late) of raw records; periods without an accepted one are left out."""
    period, late, rejected = verdict(period_us, cutoff_us)
    kept = raw.where(~rejected).select("capture_id", period.alias("period_us"), late.alias("late"))
    return kept.groupBy("capture_id", "period_us").agg(F.count(F.lit(1)).alias("n_final"), F.count(F.when(F.col("late"), 1)).alias("n_late"))


class PeriodStore:
    """The raw records and period counts under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, period_us: int = PERIOD_US, cutoff_us: int = CUTOFF_US, part_us: int = PART_US):
        if part_us % period_us:
            raise ValueError("a partition must hold whole periods")
        self.spark, self.path = spark, path or scratch_path(spark, "periods")
        self.period_us, self.cutoff_us, self.part_us = period_us, cutoff_us, part_us
        self._manifest = Manifest(spark, self.path)

    def manifest(self) -> dict:
        """batches: how many are in; parts: partition -> folders of its raw records and the one of its counts."""
        return self._manifest.read({"batches": 0, "parts": {}})

    def _commit(self, manifest: dict) -> None:
        self._manifest.commit(manifest)

    def judge(self, batch: DataFrame, done: int) -> DataFrame:
        """The batch's records with ``high``, the greatest event time their key had before them.

        The running greatest time is taken in two steps, within blocks of a key and over the blocks'
        maxima, so a key with a third of all rows is no single task.  ``batch`` has capture_id,
        block, seq, ts_us.
        """
        within = Window.partitionBy("capture_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        local = batch.withColumn("_local", F.max("ts_us").over(within))
        tops = batch.groupBy("capture_id", "block").agg(F.max("ts_us").alias("_top"))
        if done:
            tops = tops.unionByName(self._tops(done).select("capture_id", F.lit(-1).cast("bigint").alias("block"), "_top"))
        before = Window.partitionBy("capture_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = tops.withColumn("_carry", F.max("_top").over(before)).where("_carry is not null").select("capture_id", "block", "_carry")
        return local.join(carry, ["capture_id", "block"], "left").select("capture_id", "seq", "ts_us", F.greatest("_local", "_carry").alias("high"))

    def _tops(self, done: int) -> DataFrame:
        """The greatest time of each key before batch ``done``."""
        return self.spark.read.schema("capture_id string, _top bigint").parquet(f"{self.path}/tops/batch={done - 1}")

    def _in_parts(self, df: DataFrame, folder: str) -> None:
        """Write rows with ``part`` by partition; large ones are split among tasks and small ones share one."""
        df.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{folder}")

    def _part(self) -> Column:
        return F.floor(F.col("ts_us") / F.lit(self.part_us)).cast("bigint").alias("part")

    def _raw(self, parts: dict[str, dict]) -> DataFrame:
        paths = [f"{self.path}/{folder}/part={p}" for p, at in parts.items() for folder in at["raw"]]
        return self.spark.read.schema(_RAW).parquet(*paths) if paths else self.spark.createDataFrame([], _RAW)

    def add(self, batch: DataFrame) -> None:
        """Take in the next batch: records of a key with seq above all of earlier batches."""
        batch = batch.select("capture_id", "block", "seq", "ts_us")
        state = self.manifest()
        b = state["batches"]
        tops = batch.groupBy("capture_id").agg(F.max("ts_us").alias("_top"))
        if b:
            tops = tops.unionByName(self._tops(b)).groupBy("capture_id").agg(F.max("_top").alias("_top"))
        tops.write.mode("overwrite").parquet(f"{self.path}/tops/batch={b}")
        raw = f"raw/batch={b}"
        self._in_parts(self.judge(batch, b).select("*", self._part()), raw)
        parts = {k: {"raw": list(v["raw"]), "counts": v["counts"]} for k, v in state["parts"].items()}
        arrived = [str(p) for p in self._manifest.partitions(raw, "part")]
        for p in arrived:
            parts.setdefault(p, {"raw": [], "counts": None})["raw"].append(raw)
        _, _, rejected = verdict(self.period_us, self.cutoff_us)
        new = self._raw({p: {"raw": [raw]} for p in arrived})
        changed = [str(r[0]) for r in new.where(~rejected).select(self._part()).distinct().collect()]  # partitions, not rows
        full = [p for p in changed if len(parts[p]["raw"]) >= PIECES]
        replaced = [f"{at}/part={p}" for p in full for at in parts[p]["raw"]] + [f"{parts[p]['counts']}/part={p}" for p in changed if parts[p]["counts"]]
        if full:
            whole = f"raw/whole={b}"
            self._in_parts(self._raw({p: parts[p] for p in full}).select("*", self._part()), whole)
            for p in full:
                parts[p]["raw"] = [whole]
        if changed:
            counts = period_counts(self._raw({p: parts[p] for p in changed}), self.period_us, self.cutoff_us)
            part = F.floor(F.col("period_us") / F.lit(self.part_us)).cast("bigint").alias("part")
            self._in_parts(counts.select("*", part), f"counts/batch={b}")
            for p in changed:
                parts[p]["counts"] = f"counts/batch={b}"
        self._commit({"batches": b + 1, "parts": parts, "replaced": replaced})
        for path in state.get("replaced", []):  # named by neither this manifest nor the one before
            drop_path(self.spark, f"{self.path}/{path}")

    def counts(self) -> DataFrame:
        """(capture_id, period_us, n_final, n_late) as of the last batch."""
        paths = [f"{self.path}/{at['counts']}/part={p}" for p, at in self.manifest()["parts"].items() if at["counts"]]
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTS)

    def recount(self, period_us: int | None = None, cutoff_us: int | None = None) -> DataFrame:
        """The counts that another width of period or another cut-off would have given, from the retained records."""
        return period_counts(self._raw(self.manifest()["parts"]), period_us or self.period_us, self.cutoff_us if cutoff_us is None else cutoff_us)


def replay(df: DataFrame, arrivals: DataFrame | None = None, n_batches: int = 3, **limits: int) -> PeriodStore:
    """Take stored events (capture_id, block, seq, ts_us) in as ``n_batches`` arrivals of about equal size.

    ``df`` must tell rows apart by (capture_id, seq); it is read once and split by batch.  The batch
    edges are quantiles of ``seq`` in ``arrivals`` (by default ``df``); as every key arrives in seq
    order, the result doesn't depend on them.
    """
    store = PeriodStore(df.sparkSession, **limits)
    df = df.select("capture_id", "block", "seq", "ts_us")
    shares = [i / n_batches for i in range(1, n_batches)]
    edges = (df if arrivals is None else arrivals).agg(F.percentile_approx("seq", F.array(*map(F.lit, shares)), 1000)).head()[0] if shares else []
    number = sum((F.when(F.col("seq") > e, 1).otherwise(0) for e in sorted(set(edges or []))), F.lit(0))
    arrived = scratch_path(df.sparkSession, "arrivals")
    df.withColumn("batch", number).write.partitionBy("batch").parquet(arrived)
    rows = df.sparkSession.read.schema("capture_id string, block bigint, seq bigint, ts_us bigint, batch int").parquet(arrived)
    for b in range(len(set(edges or [])) + 1):
        store.add(rows.where(F.col("batch") == b))
    return store


def corrected_periods(store: PeriodStore) -> DataFrame:
    """(capture_id, period_us, n_final) of the periods that a late record changed."""
    return store.counts().where("n_late > 0").select("capture_id", "period_us", "n_final")
