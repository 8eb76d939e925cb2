"""Events of a stored capture table: one row per (capture_id, seq), in usable time.

A stored event may have been written again under a new id; of the rows of one (capture_id, seq) the
one with the smallest id counts (null ids last).  Rows without capture_id or seq identify no event
and are left out.  Usable events happened at or after 2020-01-01 and before 2030-01-01 UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.text import category_key
from seqloom.session import broadcast_if_small

#: Usable time in microseconds since 1970 UTC.
FIRST_US, END_US = 1_577_836_800_000_000, 1_893_456_000_000_000
#: Arrival numbers per block: a capture's events are spread over blocks, so that no capture, however
#: large, ends in one task, while nearly all captures stay together in one block.
BLOCK_EVENTS = 4096


def seq_block(seq: Column | str = "seq") -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / F.lit(BLOCK_EVENTS)).cast("bigint")


def distinct_events(df: DataFrame, *columns: str) -> DataFrame:
    """(capture_id, block, seq, *columns), one row per event; hash partitioned by (capture_id, block)."""
    columns = tuple(c for c in columns if c not in ("capture_id", "seq", "id", "block"))
    src = df.select("capture_id", "seq", "id", *columns).where("capture_id is not null and seq is not null")
    src = src.withColumn("block", seq_block()).repartition("capture_id", "block")
    w = Window.partitionBy("capture_id", "block", "seq").orderBy(F.col("id").asc_nulls_last())
    return src.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("capture_id", "block", "seq", *columns)


def is_usable(ts_us: Column | str = "ts_us") -> Column:
    c = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    return (c >= F.lit(FIRST_US)) & (c < F.lit(END_US))


def usable_events(df: DataFrame, *columns: str) -> DataFrame:
    """The usable events with their ``ts_us`` and ``columns``."""
    columns = tuple(c for c in columns if c != "ts_us")
    return distinct_events(df, "ts_us", *columns).where(is_usable())


def read_category(df: DataFrame, dim_category: DataFrame, column: str = "category", out: str = "category", how: str = "left") -> DataFrame:
    """Replace ``column`` by the form of ``dim_category``; unreadable is null (``how='inner'`` drops it)."""
    dim = dim_category.select(category_key("category").alias("_ckey"), F.col("category").alias("_cname"))
    dim = dim.groupBy("_ckey").agg(F.min("_cname").alias("_cname"))
    joined = df.withColumn("_ckey", category_key(column)).join(broadcast_if_small(dim), "_ckey", how)
    rest = [c for c in df.columns if c not in (column, out)]
    return joined.select(*rest, F.col("_cname").alias(out))
