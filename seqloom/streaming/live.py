"""The live side: NDJSON as it lands, through the batch operators' own functions.

Watermarks decide lateness; state lives in the session's state store and every query has a
checkpoint folder, so a lost executor or driver resumes where the last batch was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.events import is_usable
from seqloom.operators.late import PeriodStore
from seqloom.sources.ndjson import canonical_blobs, stream_lines

LATENESS = "10 minutes"


def live_events(spark: SparkSession, folder: str, salt: str, lateness: str = LATENESS) -> DataFrame:
    """Canonical events of the files that land in ``folder``, with ``ts`` as watermarked event time.

    The folder is the capture; ``seq`` is the number its lines got on arrival.
    """
    ev = canonical_blobs(stream_lines(spark, folder), salt).withColumn("seq", F.col("relay_seq"))
    return ev.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)


def deduplicated(events: DataFrame) -> DataFrame:
    """The first copy within the watermark of each (capture, user, request, second); requests 0 all stay.

    Requests 0 get a key of their own, so that one stream holds both.
    """
    keyed = events.withColumn("_second", F.floor(F.col("ts_us") / 1_000_000)).withColumn("_own", F.when(F.col("req") == 0, F.expr("uuid()")).otherwise(""))
    return keyed.dropDuplicatesWithinWatermark(["capture_id", "user_hash", "req", "_second", "_own"]).drop("_second", "_own")


def kind_counts(events: DataFrame) -> DataFrame:
    """(kind, n): counters per kind of record."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def minute_counts(events: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """(start, category, n) in tumbling or sliding windows of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def live_sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """(user_hash, start, end, n) of sessions with at most ``gap`` between neighbours; ``end`` is gap after the last event."""
    named = events.where(F.col("user_hash") != "")
    s = named.groupBy(F.session_window("ts", gap).alias("w"), "user_hash").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_hash", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def start(df: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", seconds: float | None = None) -> StreamingQuery:
    """Write ``df`` to a Parquet folder or a batch function; without ``seconds`` all that is there, then stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.foreachBatch(sink).start() if callable(sink) else writer.format("parquet").start(sink)


def period_sink(store: PeriodStore) -> Callable[[DataFrame, int], None]:
    """A batch function that takes events (capture_id, seq, ts_us) into a period store, so that late ones correct it.

    It takes what :func:`live_events` gives; events without a number are left out.  A batch that is
    run again after a failure finds itself in the manifest and is left out.
    """

    def take(batch: DataFrame, number: int) -> None:
        if number < store.manifest()["batches"]:
            return
        from seqloom.operators.events import seq_block

        store.add(batch.where(is_usable() & F.col("seq").isNotNull()).withColumn("block", seq_block()).repartition("capture_id", "block"))

    return take


def progress(query: StreamingQuery) -> dict:
    """A health record of a running query."""
    last = query.lastProgress or {}
    return {"running": query.isActive, "batch": last.get("batchId"), "rows_per_second": last.get("processedRowsPerSecond"), "input_rows": last.get("numInputRows"), "state_rows": sum(s.get("numRowsTotal", 0) for s in last.get("stateOperators", []))}
