"""Positions in ordered sequences without gathering a sequence in one task.

Rows are range partitioned by (key, time, tie) and sorted, so a key's rows lie in as many partitions
as they fill, however close together in time.  A row's position is its place in the partition,
shifted by one number per key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import BROADCAST_BYTES, broadcast_if_small, drop_table, estimated_bytes, materialise

#: Bits of ``monotonically_increasing_id`` that count within a partition.
_WITHIN = 33


def numbered(df: DataFrame, key: str, time_us: str, tie: str, out: str = "pos") -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in each key by (time, tie).

    Rows with a null key or time are left out; ``tie`` must tell apart rows of the same time for the
    numbering to be repeatable.  The sorted rows are written to the shared folder, as a base that all
    that follows can read again.
    """
    columns = df.columns
    src = materialise(df.where(F.col(key).isNotNull() & F.col(time_us).isNotNull()), "unordered")  # the bounds are sampled from it
    ranged = src.repartitionByRange(key, time_us, tie).sortWithinPartitions(key, time_us, tie)
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    drop_table(src)
    part = F.shiftright("_at", _WITHIN)
    first = ranged.groupBy(F.col(key), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = first.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    if estimated_bytes(ranged) > BROADCAST_BYTES:  # else the rows themselves are few enough to bound it
        shift = materialise(shift, "shifts")
    shift = broadcast_if_small(shift)
    return ranged.withColumn("_part", part).join(shift, [key, "_part"]).select(*columns, (F.col("_at") + F.col("_shift")).alias(out))


def running(df: DataFrame, key: str, order: str, span: int, descending: bool = False, **sums: Column) -> DataFrame:
    """``df`` with the running sum of each column up to and with the row, by ``order`` (unique in a key).

    Like the positions: summed within spans of ``span`` first, then shifted by the earlier spans.
    """
    src = df.withColumn("_span", F.floor(F.col(order) / F.lit(span)).cast("bigint")).withColumns({f"_v_{n}": c for n, c in sums.items()}).repartition(key, "_span")
    whole = src.groupBy(key, "_span").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums))
    by = F.desc if descending else F.asc
    before = Window.partitionBy(key).orderBy(by("_span")).rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(key, "_span", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    within = Window.partitionBy(key, "_span").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = src.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(within) for n in sums})
    return local.join(base, [key, "_span"]).select(*df.columns, *((F.coalesce(f"_l_{n}", F.lit(0)) + F.col(f"_b_{n}")).alias(n) for n in sums))


def exact_medians(df: DataFrame, keys: list[str], value: str, width: int, out: str = "median") -> DataFrame:
    """(keys, out): the exact median of a whole-number column in each group, null values left out.

    Values are counted in slots of ``width``; only the one or two slots that hold the middle are
    ranked, so a group with a third of all rows is neither sorted nor held in one task.
    """
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / F.lit(width)).cast("bigint").alias("_slot"))
    slots = src.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumns({"_below": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = slots.where((F.col("_below") <= high) & (F.col("_below") + F.col("_n") > low)).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy("_v")) - 1 + F.col("_below")
    rows = src.join(middle, [*keys, "_slot"]).withColumn("_rank", rank)
    return rows.where((F.col("_rank") == low) | (F.col("_rank") == high)).groupBy(*keys).agg(F.avg("_v").alias(out))
