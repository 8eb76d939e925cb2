"""What the panels come down to, one row per capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.panels import KEY, action_response, ad_dose_response, hook_lift, hook_permutation, revision_boundaries, rounded, transitions

#: Categories that say nothing about what comes before an action.
UNTOLD = ["nav", "self_surv", "presence", "notif_seen"]


def _direction(delta, band: float):
    return F.when(delta > band, "up").when(delta < -band, "down").otherwise("flat")


def view_change(ev: DataFrame, reach: int = 10, band: float = 5.0) -> DataFrame:
    """(capture_id, before, after, change_pct, direction): mean share of views in the ``reach`` places before and after actions."""
    env = action_response(ev).where((F.col("category") == "view") & (F.col("offset") != 0) & (F.abs("offset") <= reach))
    share = F.col("n") / F.col("n_all")
    means = env.groupBy(KEY).agg((F.sum(F.when(F.col("offset") < 0, share).otherwise(0.0)) / reach).alias("b"), (F.sum(F.when(F.col("offset") > 0, share).otherwise(0.0)) / reach).alias("a"))
    pct = F.when(F.col("b") > 0, (F.col("a") - F.col("b")) / F.col("b") * 100).otherwise(0.0)
    return means.select(KEY, rounded("b").alias("before"), rounded("a").alias("after"), rounded(pct, 4).alias("change_pct"), _direction(rounded(pct, 4), band).alias("direction"))


def strongest_pull(ev: DataFrame, least: float = 0.2) -> DataFrame:
    """(capture_id, from_route, to_route, p): the likeliest move between routes of each capture, above ``least``.

    Only a route's likeliest successor counts, and only if it is another route; ties in name order.
    """
    t = transitions(ev).where("n_from > 0").withColumn("p", F.col("n") / F.col("n_from"))
    best = t.groupBy(KEY, "from_route").agg(F.min_by(F.struct("to_route", "p"), F.struct(-F.col("p"), "to_route")).alias("b"))
    best = best.where((F.col("b.to_route") != F.col("from_route")) & (F.col("b.p") > least))
    top = best.groupBy(KEY).agg(F.min_by(F.struct("from_route", "b"), F.struct(-F.col("b.p"), "from_route")).alias("t"))
    return top.select(KEY, "t.from_route", F.col("t.b.to_route").alias("to_route"), rounded(F.col("t.b.p")).alias("p"))


def leading_hooks(ev: DataFrame) -> DataFrame:
    """(capture_id, rank, category, lift) of the categories that tell something, by lift, ties in name order."""
    lift = hook_lift(ev).where(~F.col("category").isin(UNTOLD))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("lift"), "category")).cast("bigint")  # eight rows a capture
    return lift.select(KEY, rank.alias("rank"), "category", "lift")


def stars(p) -> F.Column:
    """The mark of a p-value."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def tested_hooks(ev: DataFrame) -> DataFrame:
    """(capture_id, category, p, mark) of the hooks that are tested."""
    return hook_permutation(ev).select(KEY, "category", "p", stars(F.col("p")).alias("mark"))


def ad_gap(ev: DataFrame, k: int = 10, band: float = 0.02) -> DataFrame:
    """(capture_id, after_ad, base, gap, direction): cumulative probability of an action within ``k`` events of an ad and of any event."""
    d = ad_dose_response(ev).where(F.col("k") <= k)
    base = d.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("k", "cumulative", "base_n", "base_action"))).alias("c"))
    stay = F.aggregate("c", F.lit(1.0), lambda s, x: s * (1 - F.when(x["base_n"] > 0, x["base_action"] / x["base_n"]).otherwise(0.0)))
    rows = base.select(KEY, rounded(F.element_at("c", -1)["cumulative"]).alias("after_ad"), rounded(1 - stay).alias("base"))
    gap = rounded(F.col("after_ad") - F.col("base"))
    return rows.select(KEY, "after_ad", "base", gap.alias("gap"), _direction(gap, band).alias("direction"))


def revision_shift(ev: DataFrame) -> DataFrame:
    """(capture_id, n_boundaries, mean_shift, mean_rate_change_pct): mean absolute change of category shares and of the event rate."""
    r = revision_boundaries(ev)
    share = lambda s: F.col(f"n_{s}") / F.greatest(F.col(f"all_{s}"), F.lit(1))
    per = r.groupBy(KEY, "pos").agg(F.avg(F.abs(share("after") - share("before"))).alias("s"), F.max("rate_before").alias("rb"), F.max("rate_after").alias("ra"))
    return per.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_boundaries"), rounded(F.avg("s")).alias("mean_shift"), rounded(F.avg(F.when(F.col("rb") > 0, (F.col("ra") - F.col("rb")) / F.col("rb") * 100).otherwise(0.0)), 3).alias("mean_rate_change_pct"))
