"""Captures summed up and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.canonical import CATEGORIES
from seqloom.operators.panels import KEY, bursts, dominant_period, hook_lift, hover_conversion, markov_cross_validation, rounded
from seqloom.session import materialise


def capture_summary(ev: DataFrame) -> DataFrame:
    """(capture_id, n, span_us, rate_per_min, category, share) with all twelve categories."""
    n = ev.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("c"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    per = n.groupBy(KEY).agg(F.sum("c").alias("n"), (F.max("t1") - F.min("t0")).alias("span_us"))
    spine = per.withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    full = spine.join(n.select(KEY, "category", "c"), [KEY, "category"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return full.select(KEY, "n", "span_us", rounded(F.col("n") / F.greatest(F.lit(1.0), F.col("span_us") / 1e6) * 60).alias("rate_per_min"), "category", rounded(F.col("c") / F.col("n")).alias("share"))


def summary_vector(ev: DataFrame, seconds: int = 60) -> DataFrame:
    """(capture_id, n, dominant_period_min, n_bursts, hover_lift, cv_route_mean): one row per capture, 0 where a panel has too little."""
    ev = materialise(ev, "sequence")  # four panels read it
    base = ev.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    period = dominant_period(ev, seconds).select(KEY, (F.col("seconds") / 60).alias("dominant_period_min"))
    burst = bursts(ev, seconds).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_bursts"))
    hover = hover_conversion(ev).where("n_base_converted > 0").select(KEY, rounded((F.col("n_converted") / F.col("n_hovers")) / (F.col("n_base_converted") / F.col("n_base"))).alias("hover_lift"))
    cv = markov_cross_validation(ev).groupBy(KEY).agg(rounded(F.avg(F.col("n_right") / F.col("n"))).alias("cv_route_mean"))
    out = base
    for side in (period, burst, hover, cv):
        out = out.join(materialise(side, "summary"), KEY, "left")  # one row per capture each; planned together they plan for minutes
    return out.select(KEY, "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dominant_period_min", "n_bursts", "hover_lift", "cv_route_mean")))


def lift_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category, lift_a, lift_b, delta) of two captures' hook lifts; a lift that one lacks is 1."""
    left = a.select("category", F.col("lift").alias("lift_a"))
    right = b.select("category", F.col("lift").alias("lift_b"))
    both = left.join(right, "category", "full_outer").select("category", F.coalesce("lift_a", F.lit(1.0)).alias("lift_a"), F.coalesce("lift_b", F.lit(1.0)).alias("lift_b"))
    return both.withColumn("delta", rounded(F.col("lift_b") - F.col("lift_a")))


def compare_captures(ev: DataFrame, a: str, b: str) -> DataFrame:
    """Hook lifts of captures ``a`` and ``b`` side by side; the filter on the key reaches the scan."""
    lift = hook_lift(ev.where(F.col(KEY).isin(a, b)))
    return lift_deltas(lift.where(F.col(KEY) == a), lift.where(F.col(KEY) == b))


def share_ranks(ev: DataFrame) -> DataFrame:
    """(capture_id, category, n, rank): categories of each capture by count, ties in name order."""
    n = ev.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("n"), "category")).cast("bigint")
    return n.withColumn("rank", rank)


