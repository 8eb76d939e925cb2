"""Rules proposed for names that no rule decodes.

Names that share trigrams are compared through an inverted index, so no pair without a common
trigram is made; a trigram that stands in more names than the index takes is left to the rarer
trigrams of a pair, which an exact prefix bound makes enough.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.rules import HINTS, Rules
from seqloom.operators.ordered import numbered
from seqloom.session import materialise

THRESHOLD, LEAST_COUNT, LEAST_COMMON = 0.45, 2, 4


def trigrams(name: Column) -> Column:
    """The distinct trigrams of ``^^name$$`` in lower case, in order."""
    padded = F.concat(F.lit("^^"), F.lower(name), F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def name_counts(names: DataFrame, name: str = "friendly", least: int = LEAST_COUNT) -> DataFrame:
    """(name, n) of non-blank names seen at least ``least`` times."""
    n = names.where(F.coalesce(F.trim(name), F.lit("")) != "").groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least)


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, common, either): pairs a < b of distinct names whose trigrams have a Jaccard index above ``threshold``.

    Prefix filtering: with a name's trigrams ordered from the rarest, two names above the threshold
    share one of their first n - ceil(threshold * n) + 1.  Only these are joined, so frequent
    trigrams hardly meet; the index itself is then counted on the whole sets.
    """
    sets = names.select("name").distinct().select("name", trigrams(F.col("name")).alias("t"))
    grams = sets.select("name", F.size("t").alias("size"), F.explode("t").alias("g"))
    df = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ordered = grams.join(df, "g").withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("df", "g")))  # a name's own trigrams
    prefix = ordered.where(F.col("k") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1).select("name", "g", "size")
    a, b = prefix.alias("a"), prefix.alias("b")
    close = (F.col("a.g") == F.col("b.g")) & (F.col("a.name") < F.col("b.name")) & (F.least("a.size", "b.size") >= F.lit(threshold) * F.greatest("a.size", "b.size"))
    pairs = a.join(b, close).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("name").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    out = both.select("a", "b", common.cast("bigint").alias("common"), (F.size("ta") + F.size("tb") - common).cast("bigint").alias("either"))
    return out.where(F.col("common") / F.col("either") > threshold)


def merge_clusters(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, root, path): the cluster of each name, told by its first member, and its place in it.

    ``names`` has (name, place), ``edges`` (a, b, similarity) of the pairs that may merge.  Clusters
    compare by their first members: the closest pair merges first (of equal ones by place), the first
    member with the greater place leaves.  As a pair's similarity never changes, a pair that comes
    before all others of both its members merges whatever happens elsewhere; so each round merges all
    such pairs at once, and drops the pairs of the members that left.  ``path`` orders a cluster: its
    first member has none, and what merged into a member follows it in the order of merging.
    """
    spark = names.sparkSession
    place = names.select("name", "place")
    live = edges.join(place.withColumnsRenamed({"name": "a", "place": "pa"}), "a").join(place.withColumnsRenamed({"name": "b", "place": "pb"}), "b")
    key = F.struct((-F.col("similarity")).alias("far"), F.least("pa", "pb").alias("stays"), F.greatest("pa", "pb").alias("leaves"))
    live = materialise(live.select(key.alias("key")), "edges")
    merges = spark.createDataFrame([], "name bigint, up bigint, path array<struct<far:double,stays:bigint,leaves:bigint>>")
    while not live.isEmpty():
        ends = live.select("key", F.explode(F.array("key.stays", "key.leaves")).alias("p")).groupBy("p").agg(F.min("key").alias("best"))
        at = lambda end: ends.select(F.col("p").alias(f"_{end}"), F.col("best").alias(f"_best_{end}"))
        both = live.join(at("stays"), F.col("key.stays") == F.col("_stays")).join(at("leaves"), F.col("key.leaves") == F.col("_leaves"))
        now = both.where((F.col("key") == F.col("_best_stays")) & (F.col("key") == F.col("_best_leaves"))).select("key")
        now = materialise(now, "merges")
        merges = merges.unionByName(now.select(F.col("key.leaves").alias("name"), F.col("key.stays").alias("up"), F.array("key").alias("path")))
        gone = now.select(F.col("key.leaves").alias("_gone"))
        live = live.join(gone, F.col("key.stays") == F.col("_gone"), "left_anti").join(gone, F.col("key.leaves") == F.col("_gone"), "left_anti")
        live = materialise(live, "edges")
    # from the member it merged into to that one's, twice as far each round
    while True:
        merges = materialise(merges, "merges")
        above = merges.select(F.col("name").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        if merges.join(above, "up", "left_semi").isEmpty():
            break
        merges = merges.join(above, "up", "left").select("name", F.coalesce("_up", "up").alias("up"), F.concat(F.coalesce("_path", F.array().cast(merges.schema["path"].dataType)), F.col("path")).alias("path"))
    member = place.join(merges.withColumnRenamed("name", "place"), "place", "left").select("name", F.coalesce("up", "place").alias("place"), F.coalesce("path", F.array().cast(merges.schema["path"].dataType)).alias("path"))
    return member.join(place.withColumnRenamed("name", "root"), "place").select("name", "root", "path")


def _match_lengths(short: str, name: str) -> list[int]:
    """For each place of ``short``, how much from there on stands somewhere in ``name``."""
    out, size = [], 0
    for at in range(len(short)):
        size = max(0, size - 1)  # at least what was left of the match from the place before
        while at + size < len(short) and short[at : at + size + 1] in name:
            size += 1
        out.append(size)
    return out


def match_lengths(short: str, name: str) -> Column:
    @F.pandas_udf("array<int>")
    def lengths(shorts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_match_lengths(a, b) for a, b in zip(shorts, names)])

    return lengths(short, name)


def common_parts(clusters: DataFrame) -> DataFrame:
    """(root, n, part): how many names a cluster has, and the longest string that all names of a cluster contain; of equally long ones the
    earliest in its shortest name.

    Each name tells how far it matches from every place of the shortest one; the least of these over
    all names is how long a common part from there is.
    """
    short = clusters.groupBy("root").agg(F.min(F.struct(F.length("name").alias("n"), "path", "name"))["name"].alias("short"))
    each = clusters.join(short, "root").select("root", "short", F.posexplode(match_lengths("short", "name")).alias("at", "size"))
    least = each.groupBy("root", "short", "at").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    best = least.groupBy("root", "short").agg(F.min(F.struct((-F.col("size")).alias("size"), "at")).alias("b"), F.max("n").alias("n"))
    return best.select("root", "n", F.substring("short", F.col("b.at") + 1, -F.col("b.size")).alias("part"))


def escaped(text: Column) -> Column:
    """Text as a pattern that matches it."""
    return F.regexp_replace(text, r"([\\.^$*+?{}\[\]|()\-&#~\s])", r"\\$1")


def cluster_rules(clusters: DataFrame, hints: Rules = HINTS, least: int = LEAST_COMMON) -> DataFrame:
    """(root, pattern, category) of each cluster (name, root, path).

    The pattern is the common part where it is long enough, else the first three names; the category
    is the hint most names give (of equal ones that of the earlier name), without any that of the
    first member's ending.
    """
    first = clusters.withColumn("i", F.row_number().over(Window.partitionBy("root").orderBy("path"))).where("i <= 3")
    first = first.groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", escaped(F.col("name")).alias("p")))), lambda x: x["p"]), "|").alias("first"))
    told = F.coalesce(*(F.when(F.col("name").rlike(f"(?i){p}"), c) for p, c in hints), F.lit(None).cast("string"))
    votes = clusters.withColumn("hint", told).where("hint is not null").groupBy("root", "hint").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    votes = votes.groupBy("root").agg(F.min_by("hint", F.struct(-F.col("n"), "path")).alias("hint"))
    ending = F.when(F.col("root").endswith("Mutation"), "act").when(F.col("root").endswith("Query"), "view").otherwise("nav")
    rows = first.join(common_parts(clusters), "root").join(votes, "root", "left")
    long = (F.length("part") >= least) | (F.col("n") == 1)  # a name alone is its own part
    return rows.select("root", F.when(long, escaped(F.col("part"))).otherwise(F.col("first")).alias("pattern"), F.coalesce("hint", ending).alias("category"))


def propose_rules(names: DataFrame, name: str = "friendly", least: int = LEAST_COUNT, threshold: float = THRESHOLD) -> DataFrame:
    """(pattern, category, n_names, n_events, example): a rule table for review, from names no rule decodes."""
    counts = materialise(name_counts(names, name, least), "names")
    edges = similar_pairs(counts, threshold).select("a", "b", (F.col("common") / F.col("either")).alias("similarity"))
    by_count = numbered(counts.select(F.lit(0).alias("all"), "name", "n", (-F.col("n")).alias("few")), "all", "few", "name", "place")
    clusters = materialise(merge_clusters(by_count, edges), "clusters")
    sizes = clusters.join(counts, "name").groupBy("root").agg(F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_events"))
    return cluster_rules(clusters).join(sizes, "root").select("pattern", "category", "n_names", "n_events", F.col("root").alias("example"))
