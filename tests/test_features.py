import random

from pyspark.sql import functions as F

from seqloom.operators.features import feature_columns, feature_rows, feature_table

SCHEMA = "entity string, kind int, t bigint, amount double, _pane string, cells string, n bigint"


def table(spark, rows, n_types=40):
    return feature_table(spark.createDataFrame(rows, SCHEMA), "entity", "kind", n_types, "t", F.col("amount"))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, f"e{rng.randrange(9)}"]), rng.choice([None, *range(40)]), rng.randrange(1000), rng.choice([None, 0.0, -1.0, float("nan"), float("inf"), 5.0, 7.0]), "x", "y", 1) for _ in range(3000)]
    want: dict = {}
    for e, k, t, a, *_ in rows:
        cells = want.setdefault(e, {})
        if k is not None:
            n, last, s = cells.get(k, (0, 0, 0))
            cells[k] = (n + 1, max(last, t), s + (int(a) if a is not None and 0 < a < 1e15 else 0))
    got = {r["entity"]: {i: tuple(c) for i, c in enumerate(r["cells"]) if c["n"]} for r in table(spark, rows).collect()}
    assert got == want
    long = {(r["entity"], r["type"]): (r["n_events"], r["last_us"], r["latency_sum"]) for r in feature_rows(table(spark, rows), "entity", [str(i) for i in range(40)]).collect()}
    assert long == {(e, str(k)): v for e, cells in want.items() for k, v in cells.items()}


def test_every_entity_gets_all_types(spark):
    df = feature_columns(table(spark, [("a", None, 1, 1.0, "", "", 1)], 5), "entity", list("vwxyz"))
    row = df.collect()[0]
    assert len(df.columns) == 16 and row["n_v"] == 0 and row["last_z"] is None and row["sum_x"] == 0


def test_amounts_have_no_upper_bound(spark):
    rows = [("a", 0, 1, a, "", "", 1) for a in (1e15, 3e15, 5.0, float("inf"), float("nan"))]
    assert table(spark, rows).collect()[0]["cells"][0]["total"] == 4_000_000_000_000_005


def test_sums_are_exact(spark):
    whole = [9007199254740992.0, 1.0, 1.0, 1.0, 2e15, 0.5, 0.75, 123.25] * 3
    cell = lambda amounts: table(spark, [("a", 0, 1, a, "", "", 1) for a in amounts]).collect()[0]["cells"][0]["total"]
    assert cell(whole) == 3 * (9007199254740992 + 3 + 2_000_000_000_000_000 + 123) + 4
    assert cell([9.2e18, 9.2e18]) is None and cell([1e300]) is None and cell([9.2e18]) == 9_200_000_000_000_000_000 and cell([None, -5.0]) == 0


def test_empty(spark):
    assert table(spark, []).collect() == []
