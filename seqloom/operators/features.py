"""One feature row per entity from events of a fixed list of types.

A single pass aggregates the events with, for each type, a conditional count, sum and greatest time.
So that one row isn't tested against hundreds of conditions, the types are laid out in panes of
``PANE``: rows group by (entity, pane) and meet the conditions of their own pane only.  Partial
aggregation comes before the shuffle, so an entity with a third of all rows sends one small row per
task and pane.  The panes of an entity (a fixed number) are then put side by side.

Types are numbered by their order in the list; a row of no listed type adds nothing.  Null amounts,
amounts that aren't positive, NaN and infinity, which can't be summed, add 0 to the sum.  Whole parts
are summed as whole numbers, exactly and in any order, the fractions beside them, and their sum is
cut to a whole number at the end; a sum that no BIGINT holds is null.  A type that never occurred has count 0, sum 0 and
a null time.  An entity without rows of listed types still gets its row; a null entity is one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PANE = 16
_CELL = "array<struct<n:bigint,last_us:bigint,total:bigint>>"


def feature_table(df: DataFrame, entity: str, type_index: str, n_types: int, time_us: str, amount: Column) -> DataFrame:
    """(entity, cells): ``cells[i]`` is the struct (n, last_us, total) of type ``i``, for each of ``n_types``."""
    kind = F.col(type_index)
    src = df.select(F.col(entity), F.floor(kind / PANE).cast("int").alias("_pane"), F.pmod(kind, F.lit(PANE)).alias("_slot"), F.col(time_us).alias("_t"), F.when((amount > 0) & (amount < F.lit(float("inf"))), amount.cast("double")).alias("_a"))
    # an amount beyond BIGINT counts as the greatest one and 1 more, which no sum survives
    beyond = F.col("_a") >= F.lit(float(1 << 63))
    src = src.withColumns({"_w": F.floor("_a"), "_f": F.when(beyond, F.lit(1.0)).otherwise(F.col("_a") - F.floor("_a"))})
    slots = []
    for i in range(min(PANE, n_types)):
        here = F.col("_slot") == F.lit(i)
        slots += [F.count(F.when(here, F.lit(1))).alias(f"_n{i}"), F.max(F.when(here, F.col("_t"))).alias(f"_l{i}"), F.try_sum(F.when(here, F.col("_w"))).alias(f"_s{i}"), F.sum(F.when(here, F.col("_f"))).alias(f"_f{i}")]
    panes = src.groupBy(entity, "_pane").agg(*slots)
    def total(i: int) -> Column:
        """0 without any amount, null where no BIGINT holds the sum."""
        return F.when(F.col(f"_f{i}").isNotNull(), F.try_add(F.col(f"_s{i}"), F.floor(f"_f{i}"))).otherwise(F.lit(0).cast("bigint"))

    filled = F.array(*(F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_l{i}").alias("last_us"), total(i).alias("total")) for i in range(min(PANE, n_types)))).cast(_CELL)
    side = panes.select(entity, "_pane", F.when(F.col("_pane").isNotNull(), filled).alias("_cells"))
    side = side.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.when(F.col("_pane").isNotNull(), F.struct("_pane", "_cells")))).alias("_map"))
    none = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last_us"), F.lit(0).cast("bigint").alias("total")), PANE)
    n_panes = -(-n_types // PANE)
    whole = F.flatten(F.array(*(F.coalesce(F.try_element_at("_map", F.lit(i)), none) for i in range(n_panes))))
    return side.select(entity, F.slice(whole, 1, n_types).cast(_CELL).alias("cells"))


def feature_columns(table: DataFrame, entity: str, types: list[str]) -> DataFrame:
    """The feature table with flat columns ``n_<type>``, ``last_<type>`` and ``sum_<type>``; a projection."""
    flat = []
    for i, t in enumerate(types):
        cell = F.col("cells")[i]
        flat += [cell["n"].alias(f"n_{t}"), cell["last_us"].alias(f"last_{t}"), cell["total"].alias(f"sum_{t}")]
    return table.select(entity, *flat)


def feature_rows(table: DataFrame, entity: str, types: list[str], type_name: str = "type") -> DataFrame:
    """Long form: one row per entity and type that occurred."""
    names = F.array(*map(F.lit, types))
    rows = table.select(entity, F.posexplode("cells").alias("_i", "_c")).where("_c.n > 0")
    return rows.select(entity, names[F.col("_i")].alias(type_name), F.col("_c.n").alias("n_events"), F.col("_c.last_us").alias("last_us"), F.col("_c.total").alias("latency_sum"))
