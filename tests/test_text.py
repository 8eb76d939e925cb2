from pyspark.sql import functions as F

from seqloom.functions.text import base36, blank_to_null, category_key, number, plain_route, plain_user, whole_second


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_base36(spark):
    assert values(spark, base36, ["1a", "1A", "!", "", "12!", None, " 1a ", "-3", "0", "00q", "z" * 12, "z" * 13]) == [46, 46, 0, 0, 0, 0, 46, 0, 0, 26, 36**12 - 1, 0]


def test_blanks_and_case(spark):
    assert values(spark, blank_to_null, [" a ", "\t\n", "", None, "\xa0x "]) == ["a", None, None, None, "x"]
    assert values(spark, category_key, ["VIEW/album", " View-Album ", "view:album", None, "?"]) == ["view.album", "view.album", "view.album", None, "?"]
    assert values(spark, plain_route, [" a.b ", "a.b?x=1#y", "a.b #top", None, "#x", ""]) == ["a.b", "a.b", "a.b", None, "", ""]
    assert values(spark, plain_user, [" AB ", "", "  ", None]) == ["ab", None, None, None]


def test_numbers(spark):
    assert values(spark, number, ["1.5", "1.5d", "1_0", "NaN", "Infinity", " 2 ", "1e3", ".5", "", None, "abc"]) == [1.5, None, None, None, None, 2.0, 1000.0, 0.5, None, None, None]
    assert values(spark, whole_second, ["1614558469", "1614558469.999", " 1614558469.000 ", "1.6e9", "-1.5", "x", "", None]) == [1614558469, 1614558469, 1614558469, 1600000000, -2, None, None, None]
