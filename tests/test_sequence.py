import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import sequence as S
from seqloom.operators.ordered import numbered


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)


def events(spark, rng, n=150):
    rows = [(cap, i, rng.choice("vwa"), rng.choice([None, "x", "y"]), rng.choice([None, "1", "2"]), i * rng.choice([5, 5, 7])) for cap in ("a", "b") for i in range(n if cap == "a" else 5)]
    return rows, spark.createDataFrame(rows, "capture_id string, pos bigint, category string, route string, user string, ts_us bigint").repartition(5)


def by_capture(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_numbered_over_many_spans(spark):
    rng = random.Random(5)
    rows = [("a", rng.randrange(10_000), i) for i in range(500)] + [("b", None, 1), (None, 1, 1), ("b", 3, 2)]
    df = spark.createDataFrame(rows, "k string, t bigint, tie bigint").repartition(6)
    got = {(r["k"], r["t"], r["tie"]): r["pos"] for r in numbered(df, "k", "t", "tie").collect()}
    want = {r: i for i, r in enumerate(sorted(r for r in rows if r[0] == "a"))}
    want["b", 3, 2] = 0
    assert got == want


def test_one_capture_within_a_minute_is_shared_out(spark, monkeypatch):
    """No partition gets more than twice the mean, ties in time included."""
    from seqloom.operators import ordered

    written = {}
    real = ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, tag: written.setdefault(tag, real(df, tag)))
    df = spark.range(60_000).select(F.lit("one").alias("k"), F.floor(F.col("id") / 20_000).alias("t"), F.col("id").alias("tie"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbered(df.repartition(3), "k", "t", "tie")
        assert out.where("pos <> tie").count() == 0 and out.count() == 60_000
        sizes = [r[1] for r in written["ordered"].groupBy(F.shiftright("_at", 33)).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * 60_000 / len(sizes)


def test_reindex(spark):
    rows, df = events(spark, random.Random(3))
    got = {(r["capture_id"], r["old"]): r["pos"] for r in S.reindex(df.withColumn("old", F.col("pos")), F.col("category") != "w").collect()}
    assert got == {(c, r[1]): i for c, rs in by_capture(rows).items() for i, r in enumerate([r for r in rs if r[2] != "w"])}


def test_framed_next_last_running(spark):
    rows, df = events(spark, random.Random(2))
    df = S.framed(df, 3, 2, back=lambda w: F.lag("category", 3).over(w), ahead=lambda w: F.lead("category", 2).over(w))
    df = S.next_match(df, F.col("category") == "a", "ts_us")
    df = S.last_before(df, F.col("route"), "prev_route")
    df = S.running_sum(df, F.when(F.col("category") == "v", 1), "vs")
    for cap, rs in by_capture(rows).items():
        got = {r["pos"]: r for r in df.where(F.col("capture_id") == cap).collect()}
        assert len(got) == len(rs)
        for i, r in enumerate(rs):
            g = got[i]
            assert g["back"] == (rs[i - 3][2] if i >= 3 else None) and g["ahead"] == (rs[i + 2][2] if i + 2 < len(rs) else None)
            nxt = next((x for x in rs[i + 1 :] if x[2] == "a"), None)
            assert (g["next"] and (g["next"]["pos"], g["next"]["ts_us"])) == (nxt and (nxt[1], nxt[5]))
            assert g["prev_route"] == next((x[3] for x in reversed(rs[:i]) if x[3] is not None), None)
            assert g["vs"] == sum(x[2] == "v" for x in rs[: i + 1])


def test_segments(spark):
    rows = [("c", i, t * 1_000_000, u) for i, (t, u) in enumerate([(0, "u1"), (600, "u1"), (1201, "u1"), (1202, "u2"), (1203, None), (1204, "u1")])]
    df = spark.createDataFrame(rows, "capture_id string, pos bigint, ts_us bigint, user string")
    assert [r["segment_id"] for r in S.segments(df).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 2]
    assert [r["segment_id"] for r in S.segments(df, by_user=False).orderBy("pos").collect()] == [0, 0, 1, 1, 1, 1]


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, None, None), (5, None, None), (6, "skip", "s"), (7, "skip", "s")], "i int, k string, u string")
    got = [r["i"] for r in S.keep_first(df, ["k", "u"], ["i"], F.coalesce(F.col("k") != "skip", F.lit(True))).orderBy("i").collect()]
    assert got == [1, 3, 4, 6, 7]


def test_a_look_beyond_a_block_is_refused(spark):
    with pytest.raises(ValueError):
        S.framed(events(spark, random.Random(1), 5)[1], 9, 0)


def test_running_medians_and_one_row_beside(spark):
    import statistics

    from seqloom.operators.ordered import exact_medians, running

    rng = random.Random(11)
    rows = [(rng.choice("aab"), t, rng.choice([None, rng.randrange(50)])) for t in range(300)]
    df = spark.createDataFrame(rows, "capture_id string, t bigint, v bigint").repartition(5)
    for descending in (False, True):
        got = {r["t"]: r["s"] for r in running(df, "capture_id", "t", 17, descending, s=F.col("v")).collect()}
        for c in "ab":
            total = 0
            for _, t, v in sorted((r for r in rows if r[0] == c), key=lambda r: r[1], reverse=descending):
                total += v or 0
                assert got[t] == total
    got = {r["capture_id"]: r["median"] for r in exact_medians(df, ["capture_id"], "v", 3).collect()}
    assert got == {c: statistics.median(v for k, _, v in rows if k == c and v is not None) for c in "ab"}
    assert exact_medians(df.limit(0), ["capture_id"], "v", 3).collect() == []
    pos = numbered(df, "capture_id", "t", "t")
    out = S.beside(pos, pos.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))).collect()
    assert len(out) == 300 and all(r["n"] == sum(x[0] == r["capture_id"] for x in rows) for r in out)
