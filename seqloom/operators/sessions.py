"""Sessions of activity, separated by inactivity.

Secondary sort, then one linear scan: rows are range partitioned by (user, time), which splits a
user with a third of all rows over many partitions, and sorted within.  Each partition is scanned
once in Arrow batches with the one open session as its only state.  Only the first and the last
session of a partition can go on in another one; these, two per partition, are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialise

GAP_US = 600_000_000


def _scan(batches: Iterator[pa.RecordBatch], gap_us: int, key: str) -> Iterator[pa.RecordBatch]:
    """Sessions of sorted (key, time) rows; ``edge`` marks the first and the last of the partition."""
    names = [key, "start_us", "end_us", "n_events", "edge"]

    def rows(users: pa.Array, start: np.ndarray, end: np.ndarray, n: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([users, pa.array(start), pa.array(end), pa.array(n), pa.array(edge)], names)

    open_user, open_start, open_end, open_n, first = None, 0, 0, 0, True
    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        users, t = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        kind = users.type
        code = users.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((code[1:] != code[:-1]) | (t[1:] - t[:-1] > gap_us)) + 1
        at = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(t)]]) - 1
        start, end, n = t[at], t[last], last - at + 1
        if open_n and users[0].as_py() == open_user and start[0] - open_end <= gap_us:
            start[0], n[0] = open_start, n[0] + open_n
        elif open_n:
            yield rows(pa.array([open_user], kind), np.array([open_start]), np.array([open_end]), np.array([open_n]), np.array([first]))
            first = False
        if len(at) > 1:
            edge = np.zeros(len(at) - 1, bool)
            edge[0], first = first, False
            yield rows(users.take(pa.array(at[:-1])), start[:-1], end[:-1], n[:-1], edge)
        open_user, open_start, open_end, open_n = users[len(t) - 1].as_py(), int(start[-1]), int(end[-1]), int(n[-1])
    if open_n:
        yield rows(pa.array([open_user], kind), np.array([open_start]), np.array([open_end]), np.array([open_n]), np.array([True]))


def sessions(df: DataFrame, user: str = "user_hash", time_us: str = "ts_us", gap_us: int = GAP_US) -> DataFrame:
    """(user, start_us, end_us, n_events): a new session starts more than ``gap_us`` after the event before.

    Rows with a null user or time belong to no session; rows at the same time count each.  An empty
    input has no sessions.
    """
    src = df.select(user, F.col(time_us).cast("bigint").alias("_t")).where(F.col(user).isNotNull() & F.col("_t").isNotNull())
    src = materialise(src, "events")  # the bounds of the ranges are sampled from it
    kind = src.schema[user].dataType.simpleString()
    ordered = src.repartitionByRange(user, "_t").sortWithinPartitions(user, "_t")
    parts = materialise(ordered.mapInArrow(lambda it: _scan(it, gap_us, user), f"`{user}` {kind}, start_us bigint, end_us bigint, n_events bigint, edge boolean"), "sessions")
    w = Window.partitionBy(user).orderBy("start_us", "end_us")
    new = F.coalesce(F.col("start_us") - F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap_us, F.lit(True))
    edges = parts.where("edge").withColumn("_new", new.cast("int"))
    edges = edges.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(user, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
    cols = [user, "start_us", "end_us", "n_events"]
    return parts.where("not edge").select(*cols).unionByName(joined.select(*cols))


def with_duration(df: DataFrame) -> DataFrame:
    """Sessions with their duration in microseconds."""
    return df.withColumn("duration_us", F.col("end_us") - F.col("start_us"))
