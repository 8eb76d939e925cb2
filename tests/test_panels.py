"""Hand-computed cases of the panels."""

import math

import pytest
from pyspark.sql import functions as F

from seqloom.operators import panels as P
from seqloom.plans import analytics, ingest

LETTER = {"V": "view", "H": "hover", "S": "search", "A": "act", "D": "ad", "M": "msg"}


@pytest.fixture(autouse=True)
def no_least(monkeypatch):
    monkeypatch.setattr(P, "enough", lambda df, *least: df)


def seq(spark, spec, **columns):
    """Events from letters, or (seconds, letter) pairs; columns give further values by row."""
    items = [(i, c) for i, c in enumerate(spec)] if isinstance(spec, str) else spec
    rows = [("c", i, i, int(t * 1_000_000), LETTER.get(c, c), *(v[i] for v in columns.values())) for i, (t, c) in enumerate(items)]
    kinds = "".join(f", {k} {'double' if k == 'latency_ms' else 'string'}" for k in columns)
    df = spark.createDataFrame(rows, f"capture_id string, pos bigint, seq bigint, ts_us bigint, category string{kinds}")
    for c in ("route", "surface", "rev", "user"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    return df if "latency_ms" in df.columns else df.withColumn("latency_ms", F.lit(0.0))


def test_transitions_do_not_bridge_unknown_routes(spark):
    routes = list("ABAXBA")
    ev = seq(spark, "VVVVVV", route=routes, surface=[r if r != "X" else None for r in routes])
    n = {(r["from_route"], r["to_route"]): (r["n"], r["n_from"]) for r in P.transitions(ev).collect()}
    assert n == {("A", "A"): (0, 1), ("A", "B"): (1, 1), ("B", "A"): (2, 2), ("B", "B"): (0, 2)}
    assert {r["surface"]: r["n"] for r in P.route_visits(ev).collect()} == {"A": 3, "B": 2}
    assert [tuple(r)[1:] for r in P.transition_coverage(ev).collect()] == [(3, 2)]


def test_survival(spark):
    ev = seq(spark, [(0, "V"), (2, "A"), (5, "V"), (5, "H"), (9, "A"), (10, "V"), (13, "V")])
    curve = {r["t_us"] // 1_000_000: r["survival"] for r in P.survival_curve(ev).collect()}
    assert curve == {2: 0.75, 3: 0.75, 4: 0.0}
    s = P.survival_summary(ev).collect()[0]
    assert (s["n"], s["n_observed"], s["median_t_us"]) == (4, 3, 4_000_000) and s["mean_dwell_s"] == pytest.approx(10 / 3, abs=1e-6)
    assert P.survival_curve(seq(spark, [(0, "V"), (481, "A")])).count() == 0  # dropped, not censored


def test_hover_conversion(spark):
    r = P.hover_conversion(seq(spark, "HVAHVV"), window=2).collect()[0]
    assert (r["n_converted"], r["n_hovers"], r["n_base_converted"], r["n_base"], r["median_delay"]) == (1, 2, 2, 6, 2.0)


def test_hook_lift(spark):
    lift = {r["category"]: (r["n_before"], r["lift"]) for r in P.hook_lift(seq(spark, "VHAVA"), lookback=2).collect()}
    assert lift == {"view": (2, 1.25), "hover": (1, 1.25), "act": (1, 0.625)}


def test_ad_dose(spark):
    got = [(r["k"], r["n"], r["n_action"], r["cumulative"]) for r in P.ad_dose_response(seq(spark, "DADV"), most=2).orderBy("k").collect()]
    assert got == [(1, 2, 1, 0.5), (2, 1, 0, 0.5)]


def test_markov(spark):
    states = spark.createDataFrame([("c", i, s) for i, s in enumerate("abaa")], "capture_id string, pos bigint, state string")
    assert {(r["from_state"], r["to_state"]): (r["p"], r["p_unseen"]) for r in P.markov(states).collect()} == {("a", "a"): (0.5, pytest.approx(1 / 6, abs=1e-6)), ("a", "b"): (0.5, pytest.approx(1 / 6, abs=1e-6)), ("b", "a"): (0.75, 0.25)}


def test_revision_boundaries(spark):
    ev = seq(spark, "VVVVV", rev=[None, "1", "1", None, "2"])
    assert {(r["pos"], r["old_rev"], r["new_rev"]) for r in P.revision_boundaries(ev, least=0).collect()} == {(1, "", "1"), (4, "1", "2")}


def test_bursts(spark):
    counts = [2, 3, 2, 4, 3, 2, 3, 4, 3, 20]
    ev = seq(spark, [(60 * i + 0.001 * k, "V") for i, n in enumerate(counts) for k in range(n)])
    r = P.bursts(ev).collect()
    assert [(x["bucket"], x["median"], x["mad"]) for x in r] == [(9, 3.0, 1.0)] and r[0]["threshold"] == pytest.approx(8.189028, abs=1e-6)
    flat = seq(spark, [(60 * i + 0.001 * k, "V") for i, n in enumerate([1] * 9 + [50]) for k in range(n)])
    assert P.bursts(flat).count() == 0


def test_periodogram(spark):
    wave = [round(10 + 8 * math.sin(2 * math.pi * i / 8)) for i in range(64)]
    ev = seq(spark, [(60 * i + 0.01 * k, "V") for i, n in enumerate(wave) for k in range(n)])
    assert [r["seconds"] for r in P.dominant_period(ev).collect()] == [480.0]
    assert P.dominant_period(seq(spark, [(60 * i, "V") for i in range(64)])).count() == 0


def test_registered_rhythm_is_by_the_minute(spark):
    wave = [round(10 + 8 * math.sin(2 * math.pi * i / 8)) for i in range(64)]
    ev = seq(spark, [(60 * i + 0.01 * k, "V") for i, n in enumerate(wave) for k in range(n)])
    run = lambda name: analytics.PANELS[name][0](ev).collect()
    assert [r["seconds"] for r in run("dominant_period")] == [480.0]
    assert {r["bucket"]: r["n"] for r in run("rhythm_buckets")} == dict(enumerate(wave))
    assert max(run("welch_periodogram"), key=lambda r: r["power"])["period"] == 8.0


def test_telemetry_band(spark):
    ev = seq(spark, [(0, "V"), (10, "V"), (30, "V"), (30, "self_surv"), (31, "V"), (60, "self_surv")])
    assert {r["pos"]: r["n_before"] for r in P.telemetry_behaviour(ev).collect()} == {3: 2, 5: 2}


def test_peak_hour_tie(spark):
    assert P.peak_hour(seq(spark, [(3 * 3600, "V"), (7 * 3600, "V")])).collect()[0]["peak_hour"] == 3


def test_anomaly_terms(spark):
    ev = seq(spark, [(0, "V"), (0, "V"), (math.e - 1, "V")], route=["x"] * 3, latency_ms=[1000.0, 2000.0, 0.0])
    got = {r["seq"]: r["score"] for r in P.anomalies(ev).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(0.415888, abs=1e-5) and got[2] == pytest.approx(0.4, abs=1e-5)


def test_permutation_p_is_bounded(spark):
    ev = seq(spark, "MAVVVVMAVVVVMAVVVV" * 3)
    p = P.hook_permutation(ev, lookback=1, resamples=20).collect()[0]["p"]
    assert 1 / 21 - 1e-6 <= p <= 1


def test_permutation_p_of_a_strong_effect_is_below_a_hundredth(spark):
    r = P.hook_permutation(seq(spark, "VVVVVVVVMAVV" * 12), lookback=1).collect()[0]
    assert r["n_ge"] == 0 and r["p"] == pytest.approx(1 / 501, abs=1e-6)


def test_permutation_of_many_blocks_is_that_of_one(spark, monkeypatch):
    ev = seq(spark, "VVMVHVMAVVADMVS" * 9)
    one = sorted(P.hook_permutation(ev, resamples=60).collect())
    monkeypatch.setattr(P, "BLOCK", 16)
    assert sorted(P.hook_permutation(ev, resamples=60).collect()) == one and any(0 < r["n_ge"] < 60 for r in one)


def test_permutation_tests_every_hook_with_a_lift(spark):
    ev = seq(spark, "HAVVVVSAVVVVDAVVVVMAVVVV" * 6 + "H" * 3)
    lift = {r["category"]: r["lift"] for r in P.hook_lift(ev, lookback=1).collect()}
    p = {r["category"]: r["p"] for r in P.hook_permutation(ev, lookback=1).collect()}
    assert set(p) == {"hover", "search", "ad", "msg"} == {c for c in P.HOOKS if lift[c] > 1} and max(p.values()) < 0.1
    assert not P.hook_permutation(seq(spark, "VVVVVVHA" * 4), lookback=1).collect()  # four hovers are too few


def test_first_passage_is_at_least_as_sure(spark):
    rows = P.action_probability(seq(spark, "VHVAVVHAVHDVVA" * 5)).collect()
    assert rows and all(0 <= r["p_marginal"] <= 1 and 0 <= r["p_first_passage"] <= 1 for r in rows)


def test_registered_summary_is_by_the_minute(spark, monkeypatch):
    wave = [round(10 + 8 * math.sin(2 * math.pi * i / 8)) for i in range(64)]
    wave[40] = 90
    ev = seq(spark, [(60 * i + 0.01 * k, "V") for i, n in enumerate(wave) for k in range(n)])
    monkeypatch.setattr(ingest, "canonical", lambda s, d: ev)
    r = ingest.QUERIES["summary_vector"](spark, "").collect()[0]
    assert r["n_bursts"] == P.bursts(ev).count() == 1
    assert r["dominant_period_min"] == P.dominant_period(ev).collect()[0]["seconds"] / 60 > 0
