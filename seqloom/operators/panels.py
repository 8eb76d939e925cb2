"""The panels: statistics of each capture's sequence, in long form.

All take the canonical sequence and give one result per capture.  Parameters have the usual values
as defaults; captures below a panel's least size are left out, as :func:`panel_status` tells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import draws
from seqloom.operators.canonical import ACTIONS, BEHAVIOUR, CATEGORIES, SYSTEM
from seqloom.operators.ordered import exact_medians, running
from seqloom.operators.sequence import BLOCK, beside, framed, last_before, next_match, packed, reindex
from seqloom.session import materialise

KEY = "capture_id"
RESPONSE = ["act", "compose", "msg"]  # without react
WITH_ADS = [*BEHAVIOUR, "ad"]
HOOKS = ["view", "hover", "ad", "search", "msg"]  # what may lead to an action


def is_in(names: list[str]) -> Column:
    return F.col("category").isin(names)


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def per_capture(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of its capture beside each row."""
    return beside(df, df.groupBy(KEY).agg(*(c.alias(n) for n, c in aggregates.items()), F.max("pos").alias("_top")))


def enough(df: DataFrame, *least: tuple[Column, int]) -> DataFrame:
    """The rows of captures in which each condition holds for at least so many rows."""
    counts = df.groupBy(KEY).agg(*(F.count(F.when(c, 1)).alias(f"_c{i}") for i, (c, _) in enumerate(least)), F.max("pos").alias("_top"))
    for i, (_, n) in enumerate(least):
        counts = counts.where(F.col(f"_c{i}") >= n)
    return beside(df, counts.select(KEY, "_top"), "left_semi")


# -- header, hours, status ---------------------------------------------------------------------------
def header_stats(ev: DataFrame) -> DataFrame:
    """Events, actions (with react), hovers, ads, surfaces (distinct routes) and span of each capture."""
    return ev.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_events"), F.count(F.when(is_in(ACTIONS), 1)).alias("n_actions"), F.count(F.when(is_in(["hover"]), 1)).alias("n_hovers"),
        F.count(F.when(is_in(["ad"]), 1)).alias("n_ads"), F.count_distinct("route").alias("n_routes"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
    )


def panel_status(ev: DataFrame) -> DataFrame:
    """(capture_id, panel, available): whether each panel has enough events to say anything."""
    n = lambda names=None: F.count(F.when(is_in(names), 1)) if names else F.count(F.lit(1))
    c = ev.groupBy(KEY).agg(n().alias("n"), n(RESPONSE).alias("resp"), n(ACTIONS).alias("actions"), n(BEHAVIOUR).alias("beh"), n(WITH_ADS).alias("wads"), n(["hover"]).alias("hovers"), n(["ad"]).alias("ads"), n(["self_surv", "presence"]).alias("tele"), F.count_distinct(F.when(F.col("surface").isNotNull(), F.col("route"))).alias("known"))
    rules = {
        "response": F.col("resp") >= 3, "transitions": F.col("known") >= 2, "rhythm": F.col("n") >= 10, "hooks": (F.col("wads") >= 20) & (F.col("actions") >= 3), "diurnal": F.col("n") >= 1,
        "predictions": F.col("n") >= 50, "hover": (F.col("wads") >= 30) & (F.col("hovers") >= 5), "ads": (F.col("wads") >= 50) & (F.col("ads") >= 3), "revisions": F.col("n") >= 30,
        "survival": F.col("n") >= 30, "telemetry": F.col("tele") >= 1, "anomalies": (F.col("n") >= 50) & (F.col("beh") >= 50), "coverage": F.col("n") >= 1,
    }
    return c.select(KEY, F.inline(F.array(*(F.struct(F.lit(p).alias("panel"), r.alias("available")) for p, r in rules.items()))))


def diurnal(ev: DataFrame) -> DataFrame:
    """(capture_id, hour, category, n) by hour of day, UTC."""
    hour = F.floor(F.pmod(F.col("ts_us"), F.lit(86_400_000_000)) / F.lit(3_600_000_000)).cast("bigint")
    return ev.groupBy(KEY, hour.alias("hour"), "category").agg(F.count(F.lit(1)).alias("n"))


def peak_hour(ev: DataFrame) -> DataFrame:
    """The hour with most events; of equal hours the lowest."""
    n = diurnal(ev).groupBy(KEY, "hour").agg(F.sum("n").alias("n"))
    best = n.groupBy(KEY).agg(F.max(F.struct("n", -F.col("hour"))).alias("b"))
    return best.select(KEY, (-F.col("b")["col2"]).alias("peak_hour"), F.col("b")["n"].alias("n"))


# -- responses, transitions, hooks -------------------------------------------------------------------
def action_response(ev: DataFrame, window: int = 30, least: int = 3) -> DataFrame:
    """(capture_id, offset, category, n, n_all): events of each category at each offset around actions.

    ``n_all`` counts all events at the offset; only view, hover, search, act, msg and ad are listed.
    """
    shown = ["view", "hover", "search", "act", "msg", "ad"]
    names = [*shown, *(c for c in CATEGORIES if c not in shown)]
    code = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("category")).cast("int"), F.lit(0))  # 0 for any other
    origin, width, size = [names.index(c) + 1 for c in RESPONSE], 2 * window + 1, BLOCK

    @F.pandas_udf("array<bigint>")
    def around(at: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(at, v):
            dense = np.full(size + 2 * window, -1)
            dense[np.asarray(p) + window] = c
            own = window + np.flatnonzero(np.isin(dense[window : window + size], origin))
            n = np.zeros((width, len(shown) + 1), np.int64)
            for k in range(width):
                there = dense[own + k - window]
                n[k] = np.bincount(np.where(there > len(shown), 0, there)[there >= 0], minlength=len(shown) + 1)
            out.append(n.ravel())
        return pd.Series(out)

    blocks = packed(enough(ev, (is_in(RESPONSE), least)).select(KEY, "pos", "category"), window, window, code)
    n = blocks.select(KEY, F.posexplode(around("at", "v")).alias("i", "n")).where("n > 0").groupBy(KEY, "i").agg(F.sum("n").alias("n"))
    cells = len(shown) + 1
    n = n.select(KEY, (F.floor(F.col("i") / cells) - window).cast("bigint").alias("offset"), F.pmod(F.col("i"), F.lit(cells)).alias("c"), "n")
    n = n.withColumn("n_all", F.sum("n").over(Window.partitionBy(KEY, "offset"))).where("c > 0")
    return n.select(KEY, "offset", F.get(F.array(*map(F.lit, shown)), F.col("c") - 1).alias("category"), "n", "n_all")


def transitions(ev: DataFrame) -> DataFrame:
    """(capture_id, from_route, to_route, n, n_from): neighbours that are both known, zeros included."""
    pairs = framed(ev.select(KEY, "pos", "route", "surface"), 0, 1, to_route=lambda w: F.lead("route").over(w), _to=lambda w: F.lead("surface").over(w))
    n = pairs.where("surface is not null and _to is not null").groupBy(KEY, F.col("route").alias("from_route"), "to_route").agg(F.count(F.lit(1)).alias("n"))
    known = ev.where("surface is not null").groupBy(KEY).agg(F.sort_array(F.collect_set("route")).alias("r")).where(F.size("r") >= 2)
    spine = known.select(KEY, "r", F.explode("r").alias("from_route")).select(KEY, "from_route", F.explode("r").alias("to_route"))
    full = spine.join(n, [KEY, "from_route", "to_route"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("n_from", F.sum("n").over(Window.partitionBy(KEY, "from_route")))


def transition_coverage(ev: DataFrame) -> DataFrame:
    """Neighbour pairs that count and pairs left out because a route isn't known."""
    pairs = framed(ev.select(KEY, "pos", "surface"), 0, 1, _to=lambda w: F.lead("surface").over(w), _there=lambda w: F.lead("pos").over(w)).where("_there is not null")
    both = F.col("surface").isNotNull() & F.col("_to").isNotNull()
    return pairs.groupBy(KEY).agg(F.count(F.when(both, 1)).alias("n_counted"), F.count(F.when(~both, 1)).alias("n_excluded"))


def route_visits(ev: DataFrame) -> DataFrame:
    """(capture_id, surface, n) of known routes."""
    return ev.where("surface is not null").groupBy(KEY, "surface").agg(F.count(F.lit(1)).alias("n"))


def _hook_base(ev: DataFrame, *columns: str) -> DataFrame:
    return enough(reindex(ev, is_in(WITH_ADS)).select(KEY, "pos", "category", *columns), (F.lit(True), 20), (is_in(ACTIONS), 3))


def _actions_ahead(base: DataFrame, lookback: int) -> DataFrame:
    """Each event with the number of actions that have it among the ``lookback`` events before them."""
    return framed(base, 0, lookback, _ahead=lambda w: F.count(F.when(is_in(ACTIONS), 1)).over(w.rowsBetween(1, lookback)))


def _top(counts: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` most frequent names of each capture, ties in name order."""
    return counts.withColumn("_rank", F.row_number().over(Window.partitionBy(KEY, *by).orderBy(F.desc("n"), "name"))).where(F.col("_rank") <= k).drop("_rank")


def hook_routes(ev: DataFrame, lookback: int = 5) -> DataFrame:
    """(capture_id, route, n): how often events of each route stand among the ``lookback`` before an action."""
    ahead = _actions_ahead(_hook_base(ev, "route"), lookback)
    return ahead.groupBy(KEY, F.coalesce("route", F.lit("")).alias("route")).agg(F.sum("_ahead").alias("n")).where("n > 0")


def triggered(ev: DataFrame, k: int = 8) -> DataFrame:
    """(capture_id, kind, name, n): the categories of a capture's actions and their ``k`` most frequent labels."""
    actions = _hook_base(ev, "label").where(is_in(ACTIONS))
    names = F.inline(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.struct(F.lit("label").alias("kind"), F.coalesce("label", F.lit("")).alias("name"))))
    n = actions.select(KEY, names).groupBy(KEY, "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return n.where("kind = 'category'").unionByName(_top(n.where("kind = 'label'"), k))


def hook_lift(ev: DataFrame, lookback: int = 5) -> DataFrame:
    """(capture_id, category, n_before, n_base, lift): share among the events before actions over the base share."""
    base = _hook_base(ev)
    b = _actions_ahead(base, lookback).groupBy(KEY, "category").agg(F.sum("_ahead").alias("n_before"))
    n = base.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("n_base")).join(b, [KEY, "category"], "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    w = Window.partitionBy(KEY)
    p_before = F.col("n_before") / F.greatest(F.sum("n_before").over(w), F.lit(1))
    p_base = F.col("n_base") / F.sum("n_base").over(w)
    return n.select(KEY, "category", "n_before", "n_base", rounded(F.when(p_base > 0.005, p_before / p_base).otherwise(F.lit(1.0))).alias("lift"))


def hook_permutation(ev: DataFrame, lookback: int = 5, resamples: int = 500, least: int = 5) -> DataFrame:
    """(capture_id, category, n_ge, p): one-sided resampling test of the lifts of view, hover, ad, search and msg.

    Tested is what has a lift above 1 and at least ``least`` events; the categories share the resamples.
    Resample ``r`` takes as actions the positions from 1 on with the smallest ``md5(r:pos)``, as many
    as there are actions.  As each position knows how many of its predecessors are of each category, a
    resample is a few sums over blocks of positions.  A capture of one block is tested where it lies;
    longer ones first get the greatest digest of each resample, which their length and number of
    actions determine, and then add up their blocks.
    """
    base = _hook_base(ev)
    names = [f"c{i}" for i in range(len(HOOKS))]
    look = framed(base, lookback, 0, **{c: (lambda w, name=name: F.count(F.when(is_in([name]), 1)).over(w.rowsBetween(-lookback, -1))) for c, name in zip(names, HOOKS)})
    look = look.select(KEY, "pos", "category", is_in(ACTIONS).alias("is_action"), *names, F.least("pos", F.lit(lookback)).alias("d"))
    look = materialise(look, "look")
    width = len(names) + 1
    taken = lambda c: F.sum(F.when(F.col("is_action"), F.col(c))).cast("bigint")
    obs = look.groupBy(KEY).agg(F.count(F.when(F.col("is_action"), 1)).alias("a"), F.max("pos").alias("_top"), F.array(*map(taken, [*names, "d"])).alias("o"), F.array(*(F.count(F.when(is_in([name]), 1)) for name in HOOKS)).alias("n_base"))
    obs = materialise(obs, "observed")
    block = F.floor(F.col("pos") / BLOCK).cast("bigint")
    packed = look.groupBy(KEY, (block * BLOCK).alias("pos")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.array(*(F.col(c).cast("int") for c in [*names, "d"])).alias("v")))), lambda s: s["v"])).alias("v"))
    tasks = 4 * int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("array<bigint>")
    def within(v: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([draws.sums(np.asarray(x).reshape(-1, width), 0, resamples, int(k), None, BLOCK).ravel() for x, k in zip(v, a)])

    @F.pandas_udf("array<bigint>")
    def below(v: pd.Series, pos: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([draws.sums(np.asarray(x).reshape(-1, width), int(at), resamples, 0, np.asarray(m, np.int64).view(np.uint64), BLOCK).ravel() for x, at, m in zip(v, pos, limits)])

    @F.pandas_udf("bigint")
    def limit(r: pd.Series, top: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(np.array([draws.limit(int(i), int(n) + 1, min(int(k), int(n))) for i, n, k in zip(r, top, a)], np.uint64).view(np.int64))

    @F.pandas_udf("array<bigint>")
    def reached(s: pd.Series, o: pd.Series) -> pd.Series:
        # the base share is the same on both sides, so shares among predecessors compare as products
        out = []
        for x, y in zip(s, o):
            x, y = np.asarray(x).reshape(-1, width), np.asarray(y)
            out.append((x[:, :-1] * max(y[-1], 1) >= y[:-1] * np.maximum(x[:, -1:], 1)).sum(axis=0))
        return pd.Series(out)

    short = packed.join(obs.where(F.col("_top") < BLOCK), KEY).repartition(tasks, KEY).select(KEY, within("v", "a").alias("s"), "o")
    long = obs.where(F.col("_top") >= BLOCK)
    drawn = long.select(KEY, "_top", "a", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).repartition(tasks, KEY, "r").withColumn("m", limit("r", "_top", "a"))
    limits = drawn.groupBy(KEY, "_top").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "m"))), lambda s: s["m"]).alias("m"))
    parts = beside(packed, limits).repartition(tasks, KEY, "pos").select(KEY, F.posexplode(below("v", "pos", "m")).alias("i", "s"))
    added = parts.groupBy(KEY, "i").agg(F.sum("s").alias("s")).groupBy(KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda s: s["s"]).alias("s"))
    sums = short.unionByName(added.join(long.select(KEY, "o"), KEY)).select(KEY, F.posexplode(reached("s", "o")).alias("i", "n_ge"))
    at = lambda c: F.get(c, F.col("i"))
    n, before = F.col("_top") + 1, F.greatest(F.element_at("o", -1), F.lit(1))
    # the lift of hook_lift, which is 1 up to a base share of 0.005, in whole numbers
    tested = (at("n_base") >= least) & (at("n_base") * 200 > n) & (at("o") * n > at("n_base") * before)
    rows = sums.join(obs, KEY).where(tested).withColumn("category", F.get(F.array(*map(F.lit, HOOKS)), F.col("i")))
    return rows.select(KEY, "category", "n_ge", rounded((F.col("n_ge") + 1) / F.lit(float(resamples + 1))).alias("p"))


# -- rhythm --------------------------------------------------------------------------------------------
def _bucketed(ev: DataFrame, seconds: int) -> DataFrame:
    """Rows with their bucket since the capture's first event, and whether they count as activity."""
    s = per_capture(enough(ev.select(KEY, "pos", "ts_us", "category"), (F.lit(True), 10)), t0=F.min("ts_us"), t1=F.max("ts_us"), n_beh=F.count(F.when(is_in(BEHAVIOUR), 1)))
    width = seconds * 1_000_000
    n = F.greatest(F.lit(10), F.floor(F.greatest(F.lit(1_000_000), F.col("t1") - F.col("t0")) / width) + 1).cast("bigint")
    b = F.least(F.floor((F.col("ts_us") - F.col("t0")) / width), n - 1).cast("bigint")
    return s.select(KEY, "category", n.alias("n_buckets"), b.alias("bucket"), (is_in(BEHAVIOUR) | (F.col("n_beh") < 10)).alias("counts"), (F.col("n_beh") < 10).alias("all_count"))


def _busy(ev: DataFrame, seconds: int) -> DataFrame:
    """(capture_id, bucket, n, n_buckets) of the buckets with activity; every capture has at least its first bucket."""
    src = _bucketed(ev, seconds)
    n = src.groupBy(KEY, "bucket").agg(F.count(F.when(F.col("counts"), 1)).alias("n"), F.max("n_buckets").alias("n_buckets"))
    return n.where("n > 0 or bucket = 0")


def _dense(busy: DataFrame) -> DataFrame:
    """(capture_id, bucket, n) with the empty buckets: laid out block by block, so that no empty bucket is shuffled."""
    block = F.floor(F.col("bucket") / BLOCK).cast("bigint")
    packed = busy.groupBy(KEY, block.alias("_block")).agg(F.collect_list(F.pmod(F.col("bucket"), F.lit(BLOCK))).alias("at"), F.collect_list("n").alias("v"))
    spine = busy.where("bucket = 0").select(KEY, "n_buckets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_buckets") - 1) / BLOCK).cast("bigint"))).alias("_block"))

    @F.pandas_udf("array<bigint>")
    def laid_out(at: pd.Series, v: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for p, x, n in zip(at, v, size):
            dense = np.zeros(int(n), np.int64)
            if p is not None:
                dense[np.asarray(p)] = x
            out.append(dense)
        return pd.Series(out)

    size = F.least(F.lit(BLOCK), F.col("n_buckets") - F.col("_block") * BLOCK)
    rows = spine.join(packed, [KEY, "_block"], "left").select(KEY, "_block", F.posexplode(laid_out("at", "v", size)).alias("i", "n"))
    return rows.select(KEY, (F.col("_block") * BLOCK + F.col("i")).alias("bucket"), "n")


def rhythm_buckets(ev: DataFrame, seconds: int = 60) -> DataFrame:
    """(capture_id, bucket, n): dense counts of behaviour (of all events where there is too little of it)."""
    return _dense(_busy(ev, seconds))


def rhythm_by_category(ev: DataFrame, seconds: int = 60) -> DataFrame:
    """(capture_id, bucket, category, n) without zeros; where all events count as activity, those of system categories count twice."""
    src = _bucketed(ev, seconds)
    times = F.when(F.col("counts"), 1).otherwise(0) + F.when(is_in(SYSTEM), 1).otherwise(0)
    return src.groupBy(KEY, "bucket", "category").agg(F.sum(times).cast("bigint").alias("n"))


def _weighted_median(rows: DataFrame, out: str) -> DataFrame:
    """(capture_id, out) from a histogram (capture_id, v, c) in which ``v`` stands for ``c`` values."""
    w = Window.partitionBy(KEY)
    cum = rows.withColumns({"_cum": F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("c").over(w)})
    at = lambda k: F.min(F.when(F.col("_cum") > k, F.col("v")))
    return cum.groupBy(KEY).agg(((at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2).alias(out))


def bursts(ev: DataFrame, seconds: int = 60, k: float = 3.5) -> DataFrame:
    """(capture_id, bucket, n, median, mad, threshold): buckets above median + k / 0.6745 * MAD.

    Where MAD is 0 the sample deviation / 1.4826 takes its place; fewer than 5 busy buckets have no
    bursts.  Medians come from the histogram of counts, in which the empty buckets are one row, so
    these are never made; a capture has as many rows there as it has different counts.
    """
    busy = materialise(_busy(ev, seconds), "buckets")
    some = F.when(F.col("n") > 0, 1)
    per = busy.groupBy(KEY).agg(F.max("n_buckets").alias("nb"), F.count(some).alias("busy"), F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2")).where("busy >= 5")
    empty = per.select(KEY, F.lit(0.0).alias("v"), (F.col("nb") - F.col("busy")).alias("c")).where("c > 0")
    h = busy.where("n > 0").groupBy(KEY, F.col("n").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).join(per.select(KEY), KEY, "left_semi").unionByName(empty)
    h = materialise(h, "histogram")
    median = _weighted_median(h, "median")
    mad = _weighted_median(h.join(median, KEY).select(KEY, F.abs(F.col("v") - F.col("median")).alias("v"), "c"), "mad")
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("nb")) / (F.col("nb") - 1))
    limits = per.join(median, KEY).join(mad, KEY).select(KEY, "median", "mad", (F.col("median") + F.lit(k / 0.6745) * F.when(F.col("mad") == 0, sd / F.lit(1.4826)).otherwise(F.col("mad"))).alias("threshold"))
    return beside(busy.withColumn("pos", F.col("bucket")), limits).where("n > threshold and n > 0").select(KEY, "bucket", "n", "median", "mad", rounded("threshold").alias("threshold"))


def bucket_trend(ev: DataFrame, seconds: int = 60) -> DataFrame:
    """(capture_id, n_buckets, slope, intercept) of the least squares line through the buckets."""
    t = _trend(_busy(ev, seconds))
    return t.select(KEY, "n_buckets", rounded("slope", 9).alias("slope"), rounded("intercept").alias("intercept"))


def _trend(busy: DataFrame) -> DataFrame:
    """The line by its normal equations: the sums over bucket numbers are known, empty buckets add nothing to the others."""
    s = busy.groupBy(KEY).agg(F.max("n_buckets").alias("n_buckets"), F.sum("n").cast("double").alias("sy"), F.sum(F.col("n").cast("double") * F.col("bucket")).alias("sxy"))
    n, x = F.col("n_buckets").cast("double"), (F.col("n_buckets") - 1) / 2.0
    slope = (F.col("sxy") - F.col("sy") * x) / (n * (n * n - 1) / 12.0)
    return s.withColumn("slope", slope).select(KEY, "n_buckets", "sy", "sxy", "slope", (F.col("sy") / n - F.col("slope") * x).alias("intercept"))


def autocorrelation(ev: DataFrame, seconds: int = 60, lags: int = 60) -> DataFrame:
    """(capture_id, lag, r) of the detrended buckets, for lags below min(60, half the buckets).

    Empty buckets are never made.  With n the counts and L the line, the products (n - L)(n' - L') sum
    up to n n' over busy buckets, which meet in blocks of bucket numbers; n L' and L n', which follow
    from all counts but those of the first or last ``lags`` buckets; and L L', which is a closed form.
    """
    busy = materialise(_busy(ev, seconds), "buckets")
    trend = _trend(busy)
    block = F.floor(F.col("bucket") / BLOCK).cast("bigint")
    homes = F.when((F.pmod(F.col("bucket"), F.lit(BLOCK)) < lags) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = busy.select(KEY, "bucket", "n", F.explode(homes).alias("_block"))
    packed = spread.groupBy(KEY, "_block").agg(F.collect_list(F.pmod(F.col("bucket") - F.col("_block") * BLOCK, F.lit(2 * BLOCK))).alias("at"), F.collect_list(F.col("n").cast("double")).alias("v"))
    width = BLOCK  # as the worker must see it

    @F.pandas_udf("array<double>")
    def products(at: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for p, x in zip(at, v):
            dense = np.zeros(width + lags)
            dense[np.asarray(p)] = x
            own = dense[:width]
            out.append([float(own @ dense[k : k + width]) for k in range(lags)])
        return pd.Series(out)

    nn = packed.select(KEY, F.posexplode(products("at", "v")).alias("lag", "s")).groupBy(KEY, "lag").agg(F.sum("s").alias("nn"))
    # the counts and count-weighted places of the first and of the last k buckets
    head, tail = F.col("bucket"), F.col("n_buckets") - 1 - F.col("bucket")
    ends = busy.where((head < lags) | (tail < lags)).select(KEY, "n", "bucket", F.explode(F.array(F.struct(F.lit(True).alias("head"), head.alias("d")), F.struct(F.lit(False).alias("head"), tail.alias("d")))).alias("e")).where(F.col("e.d") < lags - 1)
    ends = ends.select(KEY, "n", "bucket", F.col("e.head").alias("head"), F.explode(F.sequence(F.col("e.d") + 1, F.lit(lags - 1).cast("bigint"))).alias("lag"))
    part = lambda first, c: F.coalesce(F.sum(F.when(F.col("head") == first, c)), F.lit(0.0))
    n, place = F.col("n").cast("double"), F.col("n").cast("double") * F.col("bucket")
    ends = ends.groupBy(KEY, "lag").agg(part(True, n).alias("h0"), part(True, place).alias("h1"), part(False, n).alias("t0"), part(False, place).alias("t1"))
    rows = trend.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1)))).where((F.col("lag") < F.floor(F.col("n_buckets") / 2)))
    rows = rows.join(nn, [KEY, "lag"], "left").join(ends.withColumn("lag", F.col("lag").cast("int")), [KEY, "lag"], "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    s, i, k, m = F.col("slope"), F.col("intercept"), F.col("lag").cast("double"), (F.col("n_buckets") - F.col("lag")).cast("double")
    ahead = s * (F.col("sxy") - c("t1")) + (s * k + i) * (F.col("sy") - c("t0"))
    behind = s * (F.col("sxy") - c("h1")) + (i - s * k) * (F.col("sy") - c("h0"))
    lines = s * s * (m - 1) * m * (2 * m - 1) / 6 + s * (2 * i + s * k) * (m - 1) * m / 2 + i * (s * k + i) * m
    rows = rows.select(KEY, "lag", (c("nn") - ahead - behind + lines).alias("s"))
    whole = rows.where("lag = 0").select(KEY, F.col("s").alias("s0"))
    r = F.col("s") / F.when(F.col("s0") == 0, 1.0).otherwise(F.col("s0"))
    return rows.join(whole, KEY).select(KEY, F.col("lag").cast("bigint").alias("lag"), rounded(r).alias("r"))


def periodogram(ev: DataFrame, seconds: int = 60, segment: int = 64) -> DataFrame:
    """(capture_id, k, period, power): Welch's periodogram of the detrended buckets.

    Hann windows of ``segment`` buckets (all of them, where there are fewer) overlap by half, each
    without its mean; powers average over segments.  Only segments with busy buckets are made, as rows
    of their own; in the others stands nothing but the falling line, whose power is the square of the
    slope times that of a ramp.
    """
    busy = materialise(_busy(ev, seconds), "buckets")
    length = F.least("n_buckets", F.lit(segment))
    trend = _trend(busy).select(KEY, "slope", length.alias("len"), (F.floor((F.col("n_buckets") - length) / F.greatest(F.floor(length / 2), F.lit(1))) + 1).alias("n_segments"))
    x = busy.where("n > 0").withColumn("len", length)
    step = F.greatest(F.floor(F.col("len") / 2), F.lit(1))
    last = F.floor((F.col("n_buckets") - F.col("len")) / step)
    high = F.least(F.floor(F.col("bucket") / step), last)
    low = F.greatest(F.ceil((F.col("bucket") - F.col("len") + 1) / step), F.lit(0))
    parts = x.where(low <= high).select(KEY, "bucket", "len", "n", step.alias("step"), F.explode(F.sequence(low, high)).alias("seg"))
    packed = parts.groupBy(KEY, "seg").agg(F.collect_list(F.col("bucket") - F.col("seg") * F.col("step")).alias("at"), F.collect_list(F.col("n").cast("double")).alias("v"))
    packed = packed.join(trend.select(KEY, "slope", "len"), KEY)

    def power(v: np.ndarray) -> np.ndarray:
        n = len(v)
        hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
        f = np.fft.rfft((v - v.mean()) * hann)
        return (f.real**2 + f.imag**2) / n

    @F.pandas_udf("array<double>")
    def powers(at: pd.Series, v: pd.Series, slope: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for p, c, s, n in zip(at, v, slope, size):
            dense = -s * np.arange(int(n), dtype=float)
            dense[np.asarray(p)] += c
            out.append(power(dense))
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def ramp(size: pd.Series) -> pd.Series:
        known = {n: power(np.arange(int(n), dtype=float)) for n in size.unique()}
        return size.map(known)

    p = packed.select(KEY, F.posexplode(powers("at", "v", "slope", "len")).alias("k", "power"))
    made = p.groupBy(KEY, "k").agg(F.sum("power").alias("power"), F.count(F.lit(1)).alias("made"))
    rows = trend.select(KEY, "slope", "len", "n_segments", F.posexplode(ramp("len")).alias("k", "ramp")).where("k > 0").join(made, [KEY, "k"], "left")
    empty = (F.col("n_segments") - F.coalesce("made", F.lit(0))) * F.col("slope") * F.col("slope") * F.col("ramp")
    mean = rows.withColumn("power", (F.coalesce("power", F.lit(0.0)) + empty) / F.col("n_segments"))
    return mean.select(KEY, F.col("k").cast("bigint").alias("k"), rounded(F.col("len") / F.col("k")).alias("period"), "power").where("period >= 2")


def dominant_period(ev: DataFrame, seconds: int = 60) -> DataFrame:
    """(capture_id, seconds): the strongest period above 2 buckets with twice the median power, if any."""
    p = periodogram(ev, seconds).withColumn("power", F.round("power", 6))
    rows = p.groupBy(KEY).agg(F.sort_array(F.collect_list("power")).alias("s"), F.sort_array(F.collect_list(F.struct((-F.col("power")).alias("power"), "k", "period"))).alias("p"))  # at most 32 each
    floor = F.element_at("s", F.floor(F.size("s") * 0.5).cast("int") + 1)
    best = F.filter("p", lambda r: (r["period"] > 2) & (-r["power"] > 2 * floor))
    return rows.where(F.size(best) > 0).select(KEY, (best[0]["period"] * seconds).alias("seconds"))


# -- what comes next -----------------------------------------------------------------------------------
def hover_conversion(ev: DataFrame, window: int = 10, samples: bool = False) -> DataFrame:
    """(capture_id, n_hovers, n_converted, n_base, n_base_converted, median_delay): an action within ``window`` events.

    The base is every position (``samples=False``), or min(20 * hovers, n - 1) positions drawn with
    replacement, draw i at the first 32 bits of md5(i) modulo n.
    """
    seq = enough(reindex(ev, is_in(WITH_ADS)).select(KEY, "pos", "category"), (F.lit(True), 30), (is_in(["hover"]), 5))
    near = framed(seq, 0, window, _near=lambda w: F.min(F.when(is_in(ACTIONS), F.col("pos"))).over(w.rowsBetween(1, window)))
    near = near.select(KEY, "pos", is_in(["hover"]).alias("hover"), (F.col("_near") - F.col("pos")).alias("delay"))
    hit = F.col("delay").isNotNull()
    per = near.groupBy(KEY).agg(F.count(F.when(F.col("hover"), 1)).alias("n_hovers"), F.count(F.when(F.col("hover") & hit, 1)).alias("n_converted"), F.count(F.lit(1)).alias("n_base"), F.count(F.when(hit, 1)).alias("n_base_converted"), F.percentile(F.when(F.col("hover"), F.col("delay")), F.lit(0.5)).alias("median_delay"))
    if not samples:
        return per
    draws = per.select(KEY, F.col("n_base").alias("n"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n_hovers") * 20, F.col("n_base") - 1))).alias("i"))
    draws = draws.select(KEY, F.pmod(F.conv(F.substring(F.md5(F.col("i").cast("string")), 1, 8), 16, 10).cast("bigint"), F.col("n")).alias("pos"))
    drawn = draws.groupBy(KEY, "pos").agg(F.count(F.lit(1)).alias("times")).join(near, [KEY, "pos"])
    base = drawn.groupBy(KEY).agg(F.sum("times").alias("n_base"), F.sum(F.when(hit, F.col("times")).otherwise(0)).alias("n_base_converted"))
    return per.select(KEY, "n_hovers", "n_converted", "median_delay").join(base, KEY).select(KEY, "n_hovers", "n_converted", "n_base", "n_base_converted", "median_delay")


def ad_dose_response(ev: DataFrame, most: int = 30) -> DataFrame:
    """(capture_id, k, n, n_action, cumulative, base_n, base_action): actions at +k after ads, and after any event."""
    seq = enough(reindex(ev, is_in(WITH_ADS)).select(KEY, "pos", "category"), (F.lit(True), 50), (is_in(["ad"]), 3))
    size = BLOCK

    @F.pandas_udf("array<bigint>")
    def after(at: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(at, v):
            dense = np.full(size + most, -1)  # 1 for an ad, 2 for an action, 0 for others
            dense[np.asarray(p)] = c
            own = np.flatnonzero(dense[:size] >= 0)
            ad = dense[own] == 1
            n = []
            for k in range(1, most + 1):
                there = dense[own + k]
                n += [(ad & (there >= 0)).sum(), (ad & (there == 2)).sum(), (there >= 0).sum(), (there == 2).sum()]
            out.append(n)
        return pd.Series(out)

    blocks = packed(seq, 0, most, F.when(is_in(["ad"]), 1).when(is_in(ACTIONS), 2).otherwise(0))
    cells = blocks.select(KEY, F.posexplode(after("at", "v")).alias("i", "c")).groupBy(KEY, "i").agg(F.sum("c").alias("c"))
    cell = lambda j: F.sum(F.when(F.pmod(F.col("i"), F.lit(4)) == j, F.col("c")))
    n = cells.groupBy(KEY, (F.floor(F.col("i") / 4) + 1).cast("int").alias("k")).agg(*(cell(j).alias(c) for j, c in enumerate(("n", "n_action", "base_n", "base_action")))).where("base_n > 0")
    curve = n.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("k", "n", "n_action", "base_n", "base_action"))).alias("c"))  # at most ``most`` entries
    stay = lambda upto: F.aggregate(F.slice("c", 1, upto), F.lit(1.0), lambda s, x: s * (1 - F.when(x["n"] > 0, x["n_action"] / x["n"]).otherwise(0.0)))
    out = curve.select(KEY, F.posexplode("c").alias("_i", "x"), "c")
    return out.select(KEY, F.col("x.k").cast("bigint").alias("k"), "x.n", "x.n_action", rounded(1 - stay(F.col("_i") + 1), 9).alias("cumulative"), "x.base_n", "x.base_action")


def revision_boundaries(ev: DataFrame, window: int = 50, least: int = 10) -> DataFrame:
    """(capture_id, pos, old_rev, new_rev, category, n_before, all_before, n_after, all_after, len_before, len_after).

    A boundary is a non-null revision unlike the last one before it (none at the start); the sides are
    the ``window`` events before and from it on, shares are of behaviour events.
    """
    seq = enough(ev, (F.lit(True), 30)).select(KEY, "pos", "category", "ts_us", F.nullif("rev", F.lit("")).alias("rev"))
    prev = last_before(seq, F.col("rev"), "_old").withColumn("_new", F.coalesce(F.col("rev").isNotNull() & (F.col("pos") > 0) & ~F.col("rev").eqNullSafe(F.col("_old")), F.lit(False)))
    prev = materialise(prev, "boundaries")
    at = prev.where("_new").select(KEY, F.col("pos").alias("_at"), F.coalesce("_old", F.lit("")).alias("old_rev"), F.col("rev").alias("new_rev"))
    spine = at.withColumn("pos", F.explode(F.sequence(F.col("_at") - window, F.col("_at") + window - 1)))  # boundaries are few, and only they reach out
    near = spine.join(prev.select(KEY, "pos", "category", "ts_us"), [KEY, "pos"])
    before = F.col("pos") < F.col("_at")
    count = lambda c: F.count(F.when(c, 1))
    span = lambda c: F.max(F.when(c, F.col("ts_us"))) - F.min(F.when(c, F.col("ts_us")))
    per = near.groupBy(KEY, "_at", "old_rev", "new_rev").agg(
        count(before).alias("nb"), count(~before).alias("na"), span(before).alias("tb"), span(~before).alias("ta"), count(before & is_in(BEHAVIOUR)).alias("all_before"), count(~before & is_in(BEHAVIOUR)).alias("all_after"),
        F.array(*(F.struct(F.lit(c).alias("category"), count(before & is_in([c])).alias("n_before"), count(~before & is_in([c])).alias("n_after")) for c in BEHAVIOUR)).alias("c"),
    ).where((F.col("nb") >= least) & (F.col("na") >= least))
    rate = lambda n, t: rounded(F.col(n) / F.greatest(F.lit(1.0), F.coalesce(F.col(t), F.lit(0)) / 1e6))
    rows = per.select(KEY, F.col("_at").alias("pos"), "old_rev", "new_rev", F.inline("c"), "all_before", "all_after", rate("nb", "tb").alias("rate_before"), rate("na", "ta").alias("rate_after"))
    return rows.select(KEY, "pos", "old_rev", "new_rev", "category", "n_before", "all_before", "n_after", "all_after", "rate_before", "rate_after")


# -- survival, telemetry -------------------------------------------------------------------------------
def _durations(ev: DataFrame, most_s: int = 480) -> DataFrame:
    """(capture_id, d, observed) in microseconds from each view, hover or search to the next action.

    Gaps above ``most_s`` are dropped, not censored; without a later action the time to the last
    event is censored, if it is more than 0.
    """
    seq = reindex(enough(ev, (F.lit(True), 30)), is_in(BEHAVIOUR)).select(KEY, "pos", "category", "ts_us")
    ahead = next_match(seq, is_in(ACTIONS), "ts_us").where(~is_in(ACTIONS))
    ahead = beside(ahead, seq.groupBy(KEY).agg(F.max("ts_us").alias("_end"), F.max("pos").alias("_top")))
    d = F.coalesce(F.col("next.ts_us"), F.col("_end")) - F.col("ts_us")
    rows = ahead.select(KEY, d.alias("d"), F.col("next").isNotNull().alias("observed"))
    return rows.where(F.when(F.col("observed"), F.col("d").between(0, most_s * 1_000_000)).otherwise(F.col("d") > 0))


def survival_curve(ev: DataFrame, horizon_s: int = 120) -> DataFrame:
    """(capture_id, t_us, at_risk, n_observed, survival): Kaplan-Meier up to the horizon."""
    n = _durations(ev).groupBy(KEY, F.col("d").alias("t_us")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("observed"), 1)).alias("n_observed"))
    risk = running(n, KEY, "t_us", 1_000_000, descending=True, at_risk=F.col("n")).where(F.col("t_us") <= horizon_s * 1_000_000)
    # the product of the shares that stay, as a sum of logarithms; a share of 0 is counted apart
    stay = 1 - F.col("n_observed") / F.col("at_risk")
    curve = running(risk, KEY, "t_us", 1_000_000, _ln=F.when(stay > 0, F.log(stay)).otherwise(0.0), _gone=F.when(stay > 0, 0).otherwise(1))
    return curve.select(KEY, "t_us", "at_risk", "n_observed", rounded(F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_ln"))).alias("survival"))


def survival_summary(ev: DataFrame) -> DataFrame:
    """(capture_id, n, n_observed, mean_dwell_s, median_t_us): median is the first time with survival at most one half."""
    d = _durations(ev)
    per = d.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("observed"), 1)).alias("n_observed"), rounded(F.sum(F.when(F.col("observed"), F.col("d"))) / F.count(F.when(F.col("observed"), 1)) / 1e6).alias("mean_dwell_s"))
    half = survival_curve(ev).where("survival <= 0.5").groupBy(KEY).agg(F.min("t_us").alias("median_t_us"))
    return per.where("n_observed > 0").join(half, KEY, "left").select(KEY, "n", "n_observed", "mean_dwell_s", F.coalesce("median_t_us", F.lit(-1)).alias("median_t_us"))


def telemetry_intervals(ev: DataFrame) -> DataFrame:
    """(capture_id, category, n, median_interval_s) of self_surv, presence and notif_seen; zero gaps don't count."""
    kinds = ["self_surv", "presence", "notif_seen"]
    gaps = None
    for kind in kinds:
        seq = framed(reindex(ev, is_in([kind])).select(KEY, "pos", "category", "ts_us"), 1, 0, _gap=lambda w: F.col("ts_us") - F.lag("ts_us").over(w))
        gaps = seq if gaps is None else gaps.unionByName(seq)
    gaps = materialise(gaps.select(KEY, "category", F.when(F.col("_gap") > 0, F.col("_gap")).alias("_gap")), "gaps")
    n = gaps.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("n"))
    m = exact_medians(gaps, [KEY, "category"], "_gap", 1_000_000, "_m")
    return n.join(m, [KEY, "category"], "left").select(KEY, "category", "n", rounded(F.coalesce(F.col("_m"), F.lit(-1e6)) / 1e6).alias("median_interval_s"))


def telemetry_behaviour(ev: DataFrame, seconds: int = 30) -> DataFrame:
    """(capture_id, pos, n_before): behaviour events in the ``seconds`` before each self_surv event, half open.

    A band join by time slots: a slot is as wide as the band, so a band meets two slots, and each
    behaviour event stands in its own slot and the next; no group is longer than two bands.
    """
    width = seconds * 1_000_000
    slot = F.floor(F.col("ts_us") / width)
    both = ev.where(is_in([*BEHAVIOUR, "self_surv"])).select(KEY, "pos", "ts_us", "category", slot.alias("_slot"))
    spread = both.withColumn("_s", F.explode(F.when(is_in(["self_surv"]), F.array("_slot")).otherwise(F.array("_slot", F.col("_slot") + 1))))
    w = Window.partitionBy(KEY, "_s").orderBy("ts_us").rangeBetween(-width, -1)
    n = spread.withColumn("n_before", F.count(F.when(is_in(BEHAVIOUR), 1)).over(w))
    return n.where(is_in(["self_surv"])).select(KEY, "pos", "n_before")


def telemetry_labels(ev: DataFrame, k: int = 6) -> DataFrame:
    """(capture_id, name, n): the most frequent labels of self_surv events."""
    n = ev.where(is_in(["self_surv"])).groupBy(KEY, F.coalesce("label", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return _top(n, k)


def telemetry_median_behaviour(ev: DataFrame, seconds: int = 30) -> DataFrame:
    """(capture_id, median): of the behaviour events in the ``seconds`` before a self_surv event."""
    return exact_medians(materialise(telemetry_behaviour(ev, seconds), "before"), [KEY], "n_before", 64)


# -- prediction ----------------------------------------------------------------------------------------
def _predictable(ev: DataFrame, state: str) -> DataFrame:
    """Behaviour and ad events (all, where there are fewer than 50) with their state and number."""
    ev = per_capture(enough(ev, (F.lit(True), 50)), _w=F.count(F.when(is_in(WITH_ADS), 1)))
    seq = reindex(ev, is_in(WITH_ADS) | (F.col("_w") < 50))
    return seq.select(KEY, "pos", F.coalesce(F.col(state), F.lit("")).alias("state"))


def _pairs(seq: DataFrame) -> DataFrame:
    """Each place with the state after it."""
    return framed(seq, 0, 1, to_state=lambda w: F.lead("state").over(w)).where("to_state is not null")


def _first_states(seq: DataFrame, most: int) -> DataFrame:
    """(capture_id, state, place): the first states of each capture in name order, from 1 on."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("state"))
    return seq.select(KEY, "state").distinct().withColumn("place", place).where(F.col("place") <= most)


def markov(seq: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(capture_id, from_state, to_state, n, p, p_unseen): the transitions that occur, smoothed over the capture's own states.

    ``p_unseen`` is the probability of each state that never followed; such pairs are no rows, so the
    table grows with what occurs and not with the square of the states.
    """
    n = _pairs(seq).groupBy(KEY, F.col("state").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    states = seq.groupBy(KEY).agg(F.count_distinct("state").alias("_v"))
    total = n.groupBy(KEY, "from_state").agg(F.sum("n").alias("_total")).join(states, KEY).select(KEY, "from_state", (F.col("_total") + alpha * F.col("_v")).alias("_all"))
    return n.join(total, [KEY, "from_state"]).select(KEY, "from_state", "to_state", "n", rounded((F.col("n") + alpha) / F.col("_all")).alias("p"), rounded(alpha / F.col("_all")).alias("p_unseen"))


def markov_routes(ev: DataFrame) -> DataFrame:
    return markov(_predictable(ev, "route"))


def markov_categories(ev: DataFrame) -> DataFrame:
    return markov(_predictable(ev, "category"))


def _mode(seq: DataFrame) -> DataFrame:
    """The most frequent state of each capture; of equal ones the first in order."""
    n = seq.groupBy(KEY, "state").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(KEY).agg(F.min_by("state", F.struct(-F.col("n"), "state")).alias("mode"))


def markov_holdout(ev: DataFrame, share: float = 0.8, state: str = "route") -> DataFrame:
    """(capture_id, n, n_right, n_top3, n_mode): the last part of each sequence, predicted from the first.

    All from one table of (state, next state) counts.  Of equal counts the state first in order ranks
    first; states that never followed come after those that did, in order.
    """
    seq = per_capture(_predictable(ev, state), _n=F.count(F.lit(1)))
    seq = materialise(seq, "states")
    split = F.floor(F.col("_n") * F.lit(share)).cast("bigint")
    cells = _pairs(seq).groupBy(KEY, "state", "to_state").agg(F.count(F.when(F.col("pos") + 1 < split, 1)).alias("train"), F.count(F.when(F.col("pos") >= split, 1)).alias("test"))
    w = Window.partitionBy(KEY, "state")
    trained = F.col("train") > 0
    # a cell's rank among the trained, how many these are, and how many of them come before it in name order
    cells = cells.withColumns({"_rank": F.row_number().over(w.orderBy(F.desc("train"), "to_state")), "_k": F.count(F.when(trained, 1)).over(w), "_before": F.count(F.when(trained, 1)).over(w.orderBy("to_state").rowsBetween(Window.unboundedPreceding, -1))})
    first = _first_states(seq, 6).withColumnRenamed("state", "to_state")
    tested = cells.where("test > 0").join(first, [KEY, "to_state"], "left").join(_mode(seq), KEY)
    rank = F.when(trained, F.col("_rank")).otherwise(F.col("_k") + F.col("place") - F.col("_before"))
    hits = lambda c: F.coalesce(F.sum(F.when(c, F.col("test"))), F.lit(0))
    return tested.groupBy(KEY).agg(F.sum("test").alias("n"), hits(rank == 1).alias("n_right"), hits(rank <= 3).alias("n_top3"), hits(F.col("mode") == F.col("to_state")).alias("n_mode"))


def markov_cross_validation(ev: DataFrame, folds: int = 5, state: str = "route") -> DataFrame:
    """(capture_id, fold, n, n_right, n_mode): each of ``folds`` equal parts, predicted from all before it.

    One table of (state, next state) counts by the first fold that may learn from a pair and the fold
    that is tested with it; no sequence is copied.
    """
    seq = per_capture(_predictable(ev, state), _n=F.count(F.lit(1)))
    seq = seq.withColumn("_chunk", F.floor(F.col("_n") / (folds + 1)).cast("bigint")).where("_chunk >= 10")
    seq = materialise(seq, "states")
    learnt = F.floor((F.col("pos") + 1) / F.col("_chunk")) + 1
    own = F.floor(F.col("pos") / F.col("_chunk"))
    own = F.when((own.between(1, folds)) & (F.col("pos") + 1 < F.col("_chunk") * (own + 1)), own)
    cells = _pairs(seq).select(KEY, "state", "to_state", learnt.alias("learnt"), own.alias("own")).groupBy(KEY, "state", "to_state").agg(*(F.count(F.when(F.col("learnt") <= f, 1)).alias(f"l{f}") for f in range(1, folds + 1)), *(F.count(F.when(F.col("own") == f, 1)).alias(f"t{f}") for f in range(1, folds + 1)))
    best = cells.groupBy(KEY, "state").agg(*(F.min(F.when(F.col(f"l{f}") > 0, F.struct(-F.col(f"l{f}"), F.col("to_state").alias("s"))))["s"].alias(f"b{f}") for f in range(1, folds + 1)))
    sides = _mode(seq).join(_first_states(seq, 1).select(KEY, F.col("state").alias("first")), KEY)
    rows = cells.join(best, [KEY, "state"]).join(sides, KEY)
    by_fold = F.inline(F.array(*(F.struct(F.lit(f).cast("bigint").alias("fold"), F.col(f"t{f}").alias("t"), F.coalesce(f"b{f}", "first").alias("b")) for f in range(1, folds + 1))))
    rows = rows.select(KEY, "to_state", "mode", by_fold).where("t > 0")
    hits = lambda c: F.coalesce(F.sum(F.when(F.col(c) == F.col("to_state"), F.col("t"))), F.lit(0))
    return rows.groupBy(KEY, "fold").agg(F.sum("t").alias("n"), hits("b").alias("n_right"), hits("mode").alias("n_mode"))


def prediction_summary(ev: DataFrame) -> DataFrame:
    """(capture_id, accuracy of routes, of their top 3, of the most frequent route, the lift over it, accuracy of
    categories, and mean and deviation over the folds of cross validation), 0 where there is too little."""
    part = lambda c: F.col(c) / F.col("n")
    routes = markov_holdout(ev).select(KEY, part("n_right").alias("route"), part("n_top3").alias("top3"), part("n_mode").alias("base"))
    categories = markov_holdout(ev, state="category").select(KEY, part("n_right").alias("category"))
    folds = markov_cross_validation(ev).groupBy(KEY).agg(F.avg(part("n_right")).alias("mean"), F.stddev_samp(part("n_right")).alias("sd"), F.avg(part("n_mode")).alias("fold_base"))
    out = routes.join(categories, KEY, "left").join(folds, KEY, "left")
    names = {"route_accuracy": "route", "route_top3_accuracy": "top3", "baseline_accuracy": "base", "category_accuracy": "category", "cv_route_mean": "mean", "cv_route_sd": "sd", "cv_baseline_mean": "fold_base"}
    lift = F.when(F.col("base") > 0, F.col("route") / F.col("base")).otherwise(0.0)
    return out.select(KEY, *(rounded(F.coalesce(c, F.lit(0.0))).alias(n) for n, c in names.items()), rounded(lift).alias("lift_over_baseline"))


def _latest(seq: DataFrame) -> DataFrame:
    return seq.groupBy(KEY).agg(F.max_by("state", "pos").alias("from_state"))


def next_routes(ev: DataFrame, k: int = 5, state: str = "route") -> DataFrame:
    """(capture_id, rank, to_state, p): the likeliest routes after the last event; those that never followed come last, in order."""
    seq = materialise(_predictable(ev, state), "states")
    latest = _latest(seq)
    m = markov(seq).join(latest, [KEY, "from_state"]).select(KEY, "to_state", "n", "p", "p_unseen")
    rank = lambda *by: F.row_number().over(Window.partitionBy(KEY).orderBy(*by)).cast("bigint")
    seen = m.withColumn("rank", rank(F.desc("n"), "to_state")).where(F.col("rank") <= k)
    default = m.groupBy(KEY).agg(F.max("p_unseen").alias("p"))  # a capture whose last state never led anywhere has none
    rest = _first_states(seq, 2 * k).select(KEY, F.col("state").alias("to_state")).join(seen.select(KEY, "to_state"), [KEY, "to_state"], "left_anti").join(default, KEY)
    every = seen.select(KEY, "to_state", "n", "p").unionByName(rest.select(KEY, "to_state", F.lit(0).cast("bigint").alias("n"), "p"))
    return every.withColumn("rank", rank(F.desc("n"), "to_state")).where(F.col("rank") <= k).select(KEY, "rank", "to_state", "p")


def action_probability(ev: DataFrame, steps: int = 5) -> DataFrame:
    """(capture_id, p_marginal, p_first_passage): an action within ``steps`` events after the last one.

    ``p_marginal`` multiplies the probabilities of no action at each step, ``p_first_passage`` follows
    only the paths without an action.  The chain has the twelve categories at most, so it is one small
    matrix per capture, taken in batches of captures.
    """
    seq = materialise(_predictable(ev, "category"), "states")
    m = markov(seq).groupBy(KEY).agg(F.collect_list(F.struct("from_state", "to_state", "n")).alias("m"))  # 144 cells at most
    m = m.join(seq.groupBy(KEY).agg(F.sort_array(F.collect_set("state")).alias("v")), KEY)
    packed = m.join(_latest(seq), KEY)
    actions = list(ACTIONS)

    @F.pandas_udf("p_marginal double, p_first_passage double")
    def chance(cells: pd.Series, vocabulary: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for rows, states, start in zip(cells, vocabulary, last):
            index = {s: i for i, s in enumerate(states)}
            t = np.full((len(states), len(states)), 0.5)
            for r in rows:
                t[index[r["from_state"]], index[r["to_state"]]] += r["n"]
            t /= t.sum(axis=1, keepdims=True)
            act = np.array([s in actions for s in states])
            v = np.zeros(len(states))
            v[index[start]] = 1.0
            u, stay = v.copy(), 1.0
            for _ in range(steps):
                v = v @ t
                stay *= 1 - v[act].sum()
                u = u @ t
                u[act] = 0.0
            out.append((round(1 - stay, 6), round(1 - u.sum(), 6)))
        return pd.DataFrame(out, columns=["p_marginal", "p_first_passage"])

    return packed.select(KEY, chance("m", "v", "from_state").alias("p")).select(KEY, "p.p_marginal", "p.p_first_passage")


# -- anomalies, coverage, streaks ----------------------------------------------------------------------
def streaks(seq: DataFrame, out: str = "streak") -> DataFrame:
    """Add the number of neighbours up to and with each row that share its route."""
    prev = framed(seq, 1, 0, _prev=lambda w: F.struct(F.lag("route").over(w).alias("r"), F.lag("pos").over(w).alias("p")))
    new = F.col("_prev.p").isNull() | ~F.col("route").eqNullSafe(F.col("_prev.r"))
    start = last_before(prev, F.when(new, F.col("pos")), "_start").withColumn("_start", F.when(new, F.col("pos")).otherwise(F.col("_start")))
    return start.withColumn(out, F.col("pos") - F.col("_start") + 1).drop("_prev", "_start")


def longest_streaks(ev: DataFrame) -> DataFrame:
    """(capture_id, longest, n_streaks) of equal neighbouring routes among behaviour events."""
    s = streaks(reindex(ev, is_in(BEHAVIOUR)).select(KEY, "pos", "route"))
    return s.groupBy(KEY).agg(F.max("streak").alias("longest"), F.count(F.when(F.col("streak") == 1, 1)).alias("n_streaks"))


def anomalies(ev: DataFrame, k: int = 10) -> DataFrame:
    """(capture_id, rank, seq, score, route and, where the sequence has them, label and friendly): the ``k``
    behaviour events that stand out most.

    0.4 ln(1 + gap) + surprisal of the category (alpha 1) + 0.05 (streak - 20) above 20 + 0.6
    ln(latency / 1000) above 1000; of equal scores the earlier event ranks first.
    """
    told = [c for c in ("label", "friendly") if c in ev.columns]
    seq = enough(reindex(enough(ev, (F.lit(True), 50)), is_in(BEHAVIOUR)), (F.lit(True), 50)).select(KEY, "pos", "seq", "ts_us", "category", "route", "latency_ms", *told)
    seq = materialise(seq, "behaviour")
    n = markov(seq.select(KEY, "pos", F.col("category").alias("state")), 1.0)  # every neighbour pair is among them
    states = seq.groupBy(KEY).agg(F.count_distinct("category").alias("_v"))
    total = n.groupBy(KEY, "from_state").agg(F.sum("n").alias("_total")).join(states, KEY)
    p = n.join(total, [KEY, "from_state"]).select(KEY, F.col("from_state").alias("_prev"), F.col("to_state").alias("category"), ((F.col("n") + 1) / (F.col("_total") + F.col("_v"))).alias("_p"))
    s = framed(streaks(seq), 1, 0, _prev=lambda w: F.lag("category").over(w), _gap=lambda w: (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6)
    s = s.join(p, [KEY, "_prev", "category"], "left")
    score = F.when(F.col("_gap") > 0, F.log1p("_gap") * 0.4).otherwise(0.0) + F.when(F.col("_prev").isNotNull(), -F.log(F.greatest(F.coalesce("_p", F.lit(1e-6)), F.lit(1e-6)))).otherwise(0.0)
    score = score + F.when(F.col("streak") >= 20, (F.col("streak") - 20) * 0.05).otherwise(0.0) + F.when(F.col("latency_ms") > 1000, F.log(F.col("latency_ms") / 1000) * 0.6).otherwise(0.0)
    s = s.select(KEY, "pos", "seq", rounded(score).alias("score"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("route", *told)))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("score"), "pos")).cast("bigint")
    return s.withColumn("rank", rank).where(F.col("rank") <= k).drop("pos")


def coverage(ev: DataFrame) -> DataFrame:
    """(capture_id, n_named, n_decoded, n_nameless, n_unmatched_names); nameless events are no part of the rate."""
    named = F.coalesce(F.trim("friendly") != "", F.lit(False))
    return ev.groupBy(KEY).agg(F.count(F.when(named, 1)).alias("n_named"), F.count(F.when(named & F.col("decoded"), 1)).alias("n_decoded"), F.count(F.when(~named, 1)).alias("n_nameless"), F.count_distinct(F.when(named & ~F.coalesce("decoded", F.lit(False)), F.col("friendly"))).alias("n_unmatched_names"))


def coverage_by_category(ev: DataFrame) -> DataFrame:
    """(capture_id, category, n) of all events."""
    return ev.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("n"))


def unmatched(ev: DataFrame, k: int = 50) -> DataFrame:
    """(friendly, n, tag): the most frequent names that no rule decoded."""
    tag = F.when(F.col("friendly").endswith("Mutation"), "MUT").when(F.col("friendly").endswith("Query"), "QRY").otherwise("?")
    n = ev.where(~F.coalesce("decoded", F.lit(False)) & (F.trim("friendly") != "")).groupBy("friendly").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "friendly").limit(k).withColumn("tag", tag)
