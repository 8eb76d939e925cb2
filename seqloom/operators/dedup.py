"""Exactly one copy of messages that were delivered at least once.

Identifiers are split by their aggregated frequency over all stored and new messages.  Messages whose
identifier occurs once, and messages without one, pass straight through.  Only repeated groups are
ranked, and the first of each stays: the few largest groups are found by a broadcast table of at most
``HOT_GROUPS`` rows and ranked in as many parts as they are large, then the parts' firsts among
themselves; all other groups, each of which is then smaller than one part in ``HOT_GROUPS`` of all
rows, are ranked whole.  So no group, not even one with a third of all rows, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.blobs import json_object
from seqloom.functions.text import base36, stripped, whole_second
from seqloom.session import materialise

#: Groups beyond this many copies may be taken as hot, and at most so many of them are.
HOT_COPIES, HOT_GROUPS = 10_000, 1000

_FIELDS = ("__type", "__kind", "__req", "__crn", "__user", "fb_api_req_friendly_name", "__spin_t")


def messages(lines: DataFrame) -> DataFrame:
    """(line_id, ident): the messages among relay lines and the identifier that tells their copies.

    A message is a JSON object, not a hello frame, with ``__kind`` absent or ``request`` and a
    non-blank ``__crn``.  ``ident`` is the MD5 of capture, user, ``__crn``, friendly name, whole
    second and request number, each without outer blanks, null, absent and blank being equal; it is
    null where ``__req`` identifies nothing.  A second that can't be read counts as absent.
    """
    m = lines.select("line_id", F.col("capture_id").alias("_cap"), json_object("line", _FIELDS).alias("m")).where("m is not null")
    field = lambda f: F.coalesce(stripped(F.col(f"m.`{f}`")), F.lit(""))
    m = m.where((field("__type") != "hello") & field("__kind").isin("", "request") & (field("__crn") != ""))
    req = base36(F.col("m.`__req`"))
    parts = [F.coalesce(stripped("_cap"), F.lit("")), field("__user"), field("__crn"), field("fb_api_req_friendly_name"), F.coalesce(whole_second(F.col("m.`__spin_t`")).cast("string"), F.lit("")), req.cast("string")]
    return m.select("line_id", F.when(req != 0, F.unhex(F.md5(F.concat_ws("\x1f", *parts)))).alias("ident"))


def frequencies(ids: DataFrame, row: str = "line_id", ident: str = "ident") -> DataFrame:
    """(ident, n, only) of every identifier, aggregated before and after one shuffle; ``only`` is its row where n is 1."""
    return ids.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("only"))


def ranked_copies(ids: DataFrame, repeated: DataFrame, row: str = "line_id", ident: str = "ident") -> DataFrame:
    """(row, kept, first) for every row of a repeated group: the row that stays, and whether it is this one.

    Rows rank by their id, null ids last; of rows with the same id one is first.
    """
    hot = repeated.where(F.col("n") > HOT_COPIES).orderBy(F.desc("n"), ident).limit(HOT_GROUPS)
    hot = F.broadcast(hot.select(ident, F.ceil(F.col("n") / HOT_COPIES).alias("_parts")))
    cold = repeated.select(ident).join(hot, ident, "left_anti")
    parted = ids.join(hot, ident).select(row, ident, F.pmod(F.xxhash64(row), F.col("_parts")).alias("_part"))
    whole = ids.join(hot, ident, "left_anti").join(cold, ident).select(row, ident)
    by_row = F.col(row).asc_nulls_last()
    group = Window.partitionBy(ident).orderBy(by_row)
    whole = whole.select(row, F.first(row).over(group).alias("kept"), (F.row_number().over(group) == 1).alias("first"))
    part = Window.partitionBy(ident, "_part").orderBy(by_row)
    parted = parted.withColumn("_rank", F.row_number().over(part))
    # one row per part; of a hot group that is one in HOT_COPIES
    top = parted.where("_rank = 1").groupBy(ident).agg(F.min(row).alias("kept"))
    parted = parted.join(F.broadcast(top), ident)  # HOT_GROUPS rows at most
    parted = parted.select(row, "kept", ((F.col("_rank") == 1) & F.col(row).eqNullSafe(F.col("kept"))).alias("first"))
    return whole.unionByName(parted)


def split_copies(ids: DataFrame, stored: DataFrame | None = None, row: str = "line_id", ident: str = "ident") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) over all stored and new rows of (row, ident).

    ``kept`` has one row id per message, ``dropped`` has (kept id, dropped id).  The first id of a
    group stays; a row id that occurs twice in a group stays once.  Empty input gives two empty results.
    """
    both = ids.select(row, ident) if stored is None else stored.select(row, ident).unionByName(ids.select(row, ident))
    both = materialise(both, "messages")
    freq = frequencies(both, row, ident)
    repeated = materialise(freq.where("n > 1").select(ident, "n"), "repeated")
    singles = both.where(F.col(ident).isNull()).select(row).unionByName(freq.where("n = 1").select(F.col("only").alias(row)))
    ranked = ranked_copies(both, repeated, row, ident)
    kept = singles.unionByName(ranked.where("first").select(row))
    dropped = ranked.where("not first").select(F.col("kept").alias(f"{row}_kept"), F.col(row).alias(f"{row}_dropped"))
    return kept, dropped
