"""Primitives over ordered sequences that hold for a sequence of any length.

A sequence is cut into blocks of ``BLOCK`` places.  Looks at a bounded distance use blocks that
repeat their neighbours' nearest places; looks at any distance are answered within the block first
and then by one row per block.  No frame ends at unboundedFollowing: what lies ahead is found by
ordering the other way round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 4096
KEY, POS = "capture_id", "pos"


def reindex(df: DataFrame, keep: Column) -> DataFrame:
    """The rows that ``keep`` holds for, numbered anew in their order: counted within blocks, then over the blocks."""
    kept = _blocked(df.where(keep))
    local = kept.withColumn("_local", F.row_number().over(Window.partitionBy(KEY, "_block").orderBy(POS)) - 1)
    size = kept.groupBy(KEY, "_block").agg(F.count(F.lit(1)).alias("_n"))
    blocks = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = size.select(KEY, "_block", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_carry"))
    return local.join(carry, [KEY, "_block"]).withColumn(POS, F.col("_local") + F.col("_carry")).select(*df.columns)


def framed(df: DataFrame, before: int, after: int, **columns: Callable[[Window], Column]) -> DataFrame:
    """Add columns that look at most ``before`` places back and ``after`` ahead.

    Each column is a function of the ordered window (``lag``, ``lead`` or a ``rowsBetween`` frame).
    """
    if max(before, after) > BLOCK:
        raise ValueError(f"a look may reach {BLOCK} places at most")
    block, at = F.floor(F.col(POS) / BLOCK).cast("bigint"), F.pmod(F.col(POS), F.lit(BLOCK))
    homes = F.array_compact(F.array(block, F.when((at < after) & (block > 0), block - 1), F.when(at >= BLOCK - before, block + 1)))
    spread = df.withColumn("_home", block).withColumn("_block", F.explode(homes)).repartition(KEY, "_block")
    w = Window.partitionBy(KEY, "_block").orderBy(POS)
    return spread.select("*", *(f(w).alias(n) for n, f in columns.items())).where("_home = _block").drop("_home", "_block")


def packed(df: DataFrame, before: int, after: int, value: Column) -> DataFrame:
    """(capture_id, at, v): one row per block, with the places (from the block's start on, -``before`` to
    ``BLOCK`` + ``after``) and the non-null whole-number values of its rows and of the nearest of its neighbours."""
    if max(before, after) > BLOCK:
        raise ValueError(f"a look may reach {BLOCK} places at most")
    block, at = F.floor(F.col(POS) / BLOCK).cast("bigint"), F.pmod(F.col(POS), F.lit(BLOCK))
    homes = F.array_compact(F.array(block, F.when((at < after) & (block > 0), block - 1), F.when(at >= BLOCK - before, block + 1)))
    spread = df.select(KEY, POS, value.cast("int").alias("v"), F.explode(homes).alias("_block"))
    return spread.groupBy(KEY, "_block").agg(F.collect_list((F.col(POS) - F.col("_block") * BLOCK).cast("int")).alias("at"), F.collect_list("v").alias("v")).drop("_block")


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(POS) / BLOCK).cast("bigint")).repartition(KEY, "_block")


def next_match(df: DataFrame, match: Column, *columns: str, out: str = "next") -> DataFrame:
    """Add ``out``: the struct (pos, *columns) of the nearest later row that ``match`` holds for, or null."""
    hit = F.when(match, F.struct(POS, *columns))
    src = _blocked(df)
    ahead = Window.partitionBy(KEY, "_block").orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, -1)
    local = src.withColumn("_local", F.last(hit, ignorenulls=True).over(ahead))
    tops = src.groupBy(KEY, "_block").agg(F.min(hit).alias("_first"))
    blocks = Window.partitionBy(KEY).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(KEY, "_block", F.last("_first", ignorenulls=True).over(blocks).alias("_carry"))
    return local.join(carry, [KEY, "_block"]).withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry", "_block")


def last_before(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` of the rows before, or null."""
    src = _blocked(df).withColumn("_value", F.when(value.isNotNull(), F.struct(F.col(POS), value.alias("v"))))
    back = Window.partitionBy(KEY, "_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    local = src.withColumn("_local", F.last("_value", ignorenulls=True).over(back))
    tops = src.groupBy(KEY, "_block").agg(F.max("_value").alias("_last"))
    blocks = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(KEY, "_block", F.last("_last", ignorenulls=True).over(blocks).alias("_carry"))
    return local.join(carry, [KEY, "_block"]).withColumn(out, F.coalesce("_local", "_carry")["v"]).drop("_value", "_local", "_carry", "_block")


def running_sum(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to and with this one (null counts 0)."""
    src = _blocked(df).withColumn("_value", F.coalesce(value, F.lit(0)).cast("bigint"))
    local = src.withColumn("_local", F.sum("_value").over(Window.partitionBy(KEY, "_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)))
    tops = src.groupBy(KEY, "_block").agg(F.sum("_value").alias("_sum"))
    blocks = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(KEY, "_block", F.coalesce(F.sum("_sum").over(blocks), F.lit(0)).alias("_carry"))
    return local.join(carry, [KEY, "_block"]).withColumn(out, F.col("_local") + F.col("_carry")).drop("_value", "_local", "_carry", "_block")


def islands(df: DataFrame, starts: Column, out: str = "island") -> DataFrame:
    """Number the stretches of rows; ``starts`` is true on a stretch's first row."""
    return running_sum(df, starts.cast("int"), out)


def segments(df: DataFrame, gap_us: int = 600_000_000, by_user: bool = True, out: str = "segment_id") -> DataFrame:
    """Number segments from 0: a new one after more than ``gap_us``, or where both this and the previous
    row have a user and they differ (a row without user between two users hides the change)."""
    prev = framed(df, 1, 0, _t=lambda w: F.lag("ts_us").over(w), _u=lambda w: F.lag("user").over(w))
    new = F.col("ts_us") - F.col("_t") > gap_us
    if by_user:
        new = new | F.coalesce(F.col("user") != F.col("_u"), F.lit(False))
    return islands(prev, F.coalesce(new, F.lit(False)), out).drop("_t", "_u")


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str], applies: Column) -> DataFrame:
    """Of the rows ``applies`` holds for, keep the first of each key; the others stay as they are.

    Nulls in a key are equal.  The smallest order is aggregated before the shuffle and joined back,
    so a key with a third of all rows is no single task.
    """
    named = [F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    src = df.select("*", *named, F.struct(*order).alias("_o"))
    best = src.where(applies).groupBy(*names).agg(F.min("_o").alias("_best"))
    on = [src[n].eqNullSafe(best[n]) for n in names]
    first = src.where(applies).join(best, [*on, src["_o"] == best["_best"]], "left_semi")
    return first.unionByName(src.where(~applies)).select(*df.columns)


#: Places of a sequence that meet their capture's one row together.
PART = 1 << 17


def beside(df: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """Join the one row that ``per`` has of each capture to the capture's rows.

    The rows of a capture meet it in parts of ``PART`` places, so a capture with a third of all rows is
    as many join keys as it is long; the one row is repeated for each part the capture has, which is
    one for nearly all.  ``per`` may bring the capture's greatest position as ``_top``.
    """
    if "_top" not in per.columns:
        per = per.join(df.groupBy(KEY).agg(F.max(POS).alias("_top")), KEY)
    part = F.floor(F.col(POS) / PART).cast("bigint")
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_top") / PART).cast("bigint"))
    return df.withColumn("_part", part).join(per.withColumn("_part", F.explode(parts)).drop("_top"), [KEY, "_part"], how).drop("_part")
