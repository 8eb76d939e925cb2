from pyspark.sql import functions as F

from seqloom.operators.events import FIRST_US, distinct_events, read_category, usable_events

SCHEMA = "id bigint, capture_id string, seq bigint, ts_us bigint, category string, block string, _rank int, extra string"


def test_smallest_id_counts_and_nulls(spark):
    rows = [(5, "a", 1, FIRST_US, "x", "b", 1, "e"), (3, "a", 1, FIRST_US + 7, "y", "b", 1, "e"), (None, "a", 1, 1, "z", "b", 1, "e"), (1, None, 1, FIRST_US, "q", "", 1, ""), (2, "a", None, FIRST_US, "q", "", 1, ""), (9, "b", 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["capture_id"], r["seq"], r["ts_us"], r["category"]) for r in distinct_events(df, "ts_us", "category").collect()}
    assert got == {("a", 1, FIRST_US + 7, "y"), ("b", 1, None, None)}


def test_the_kept_row_decides_whether_an_event_is_usable(spark):
    df = spark.createDataFrame([(1, "a", 1, None, "x", "", 0, ""), (2, "a", 1, FIRST_US, "x", "", 0, ""), (3, "a", 2, FIRST_US - 1, "x", "", 0, ""), (4, "a", 3, FIRST_US, "x", "", 0, "")], SCHEMA)
    assert [r["seq"] for r in usable_events(df).collect()] == [3]
    assert usable_events(df.limit(0), "category").collect() == []


def test_category_reading(spark):
    dim = spark.createDataFrame([("view.album",), ("act.pin",)], "category string")
    df = spark.createDataFrame([(1, "VIEW-Album "), (2, "view."), (3, None), (4, "act/pin")], "i int, category string")
    assert {(r["i"], r["category"]) for r in read_category(df, dim).collect()} == {(1, "view.album"), (2, None), (3, None), (4, "act.pin")}
    assert read_category(df, dim, how="inner").count() == 2
    assert read_category(df, dim.where(F.lit(False))).where("category is null").count() == 4
