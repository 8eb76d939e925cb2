import random

from seqloom.operators.sessions import sessions, with_duration


def brute(rows, gap):
    out, by = [], {}
    for u, t in rows:
        if u is not None and t is not None:
            by.setdefault(u, []).append(t)
    for u, ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.append((u, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((u, start, prev, n))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", None, f"u{rng.randrange(20)}"]), rng.choice([None, rng.randrange(4000)])) for _ in range(4000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "user_hash string, ts_us bigint, start_us string, edge int").repartition(7)
    got = sorted(map(tuple, sessions(df, gap_us=10).collect()))
    assert got == brute(rows, 10)
    # one user whose only session spans every partition
    one = spark.range(5000).selectExpr("'u' as user_hash", "id as ts_us")
    assert [tuple(r) for r in sessions(one, gap_us=1).collect()] == [("u", 0, 4999, 5000)]


def test_gap_is_strict_and_ties_count(spark):
    df = spark.createDataFrame([("u", 0), ("u", 0), ("u", 600), ("u", 1201)], "user_hash string, ts_us bigint")
    got = sorted(map(tuple, with_duration(sessions(df, gap_us=600)).collect()))
    assert got == [("u", 0, 600, 3, 600), ("u", 1201, 1201, 1, 0)]


def test_empty(spark):
    assert sessions(spark.createDataFrame([], "user_hash string, ts_us bigint")).collect() == []
