import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions.rules import HINTS, RULES, by_name, by_path, decoded_category, decoder, unreachable
from seqloom.operators.discover import _match_lengths, cluster_rules, merge_clusters, propose_rules, similar_pairs, trigrams
from seqloom.operators import store as store_module
from seqloom.operators.sequence import segments
from seqloom.operators.store import CaptureStore
from seqloom.session import estimated_bytes, source_bytes
from seqloom.sources import ndjson
from seqloom.sources.ndjson import canonical_blobs, ordered_events, quarantine, read_lines, source_repeats

LINES = [
    '{"__type":"hello"}', "", "{bad", "[1,2]", '{"__req":"a","__crn":"r1","__spin_t":100,"__user":"u1"}', '{"__req":"a","__crn":"r2","__spin_t":100,"__user":"u1"}', '{"__req":"!","__crn":"r1","__spin_t":100}', '{"__req":"!","__crn":"r1","__spin_t":100}',
    '{"__req":"c","__spin_t":100}', '{"__req":"d","__crn":"r1","__spin_t":"abc"}', '{"__kind":"input","__spin_t":105,"__crn":"/p"}', '{"__req":"b","__crn":"r1","__spin_t":706,"__user":"u1"}',
]


def test_ingest(spark, tmp_path):
    (tmp_path / "one.ndjson").write_text("\n".join(LINES))
    lines = read_lines(spark, str(tmp_path))
    ev = ordered_events(canonical_blobs(lines, "salt"))
    rows = ev.orderBy("seq").collect()
    assert [r["req"] for r in rows] == [0, 0, 10, 0, 11] and [r["seq"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[2]["route"] == "r1" and rows[3]["category"] == "presence" and rows[3]["label"] == "input"
    assert len(rows[2]["user_hash"]) == 12 and rows[0]["user_hash"] == "" and rows[2]["latency_ms"] == 0.0
    seg = segments(ev.withColumn("pos", F.col("seq")).withColumn("user", F.nullif("user_hash", F.lit(""))))
    assert [r["segment_id"] for r in seg.orderBy("pos").collect()] == [0, 0, 0, 0, 1]
    assert {(r["line"], r["outcome"]) for r in quarantine(lines).collect()} == {("{bad", "broken"), ("[1,2]", "broken"), (LINES[8], "rejected"), (LINES[9], "rejected")}


def test_source_repeats(spark):
    rows = [(0, 0, "r", "f"), (1, 400, "r", "f"), (2, 600, "r", "f"), (3, 700, "r", "f"), (4, 750, "q", "f"), (5, 800, "r", "f")]
    df = spark.createDataFrame([("c", i, t * 1000, r, f) for i, t, r, f in rows], "capture_id string, line_id bigint, ts_us bigint, route string, friendly string")
    assert sorted(r["line_id"] for r in source_repeats(df).collect()) == [0, 2, 4, 5]


def test_fallbacks_and_rules(spark):
    df = spark.createDataFrame([("FooMutation", "", "r"), ("FooQuery", "", "r"), ("Foo", "", "r"), ("", "/x/gating", "r"), ("", "", "r"), (None, None, None), ("SharePostMutation", "", ""), ("XSharedThing", "", ""), ("hovercard", "", "")], "n string, p string, r string")
    got = [r["c"] for r in df.select(decoded_category(F.col("n"), F.col("p"), F.col("r"))["category"].alias("c")).collect()]
    assert got == ["act", "view", "nav", "nav", "view", "nav", "act", "nav", "hover"]
    assert [r[0] for r in spark.createDataFrame([("/a/unified_cvc",), ("/z",), (None,)], "p string").select(by_path(F.col("p"))).collect()] == ["presence", None, None]
    assert spark.createDataFrame([(None,), ("",)], "n string").where(by_name("n")["rule_id"].isNotNull()).count() == 0
    own = decoder([("x", "ad")])
    assert own("aXb") == (0, "ad") and own("Query") == (-3, "view")


def test_rule_table():
    assert len(RULES) == 118 and len(HINTS) == 20
    assert all(re.compile(p) for p, _ in RULES + HINTS)
    assert any(r > e for r, e in unreachable())


def test_similarity(spark):
    df = spark.createDataFrame([("ab",), ("ac",), ("LongSharedNameQuery",), ("LongSharedNameMutation",), (None,)], "name string")
    t = {r["name"]: set(r["t"]) for r in df.where("name is not null").select("name", trigrams(F.col("name")).alias("t")).collect()}
    assert len(t["ab"]) == 4 and len(t["ab"] & t["ac"]) == 1
    names = [*t, "LongSharedNameQueries", "abc", "abcd"]
    grams = {n: {("^^" + n.lower() + "$$")[i : i + 3] for i in range(len(n) + 2)} for n in names}
    for threshold in (0.1, 0.45, 0.8):
        want = {(a, b, len(grams[a] & grams[b]), len(grams[a] | grams[b])) for a in names for b in names if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > threshold}
        assert set(map(tuple, similar_pairs(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect())) == want


def grouped(spark, names, edges):
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place bigint")
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a string, b string, similarity double")
    rows = merge_clusters(nodes, pairs).orderBy("root", "path").collect()
    return {root: [r["name"] for r in rows if r["root"] == root] for root in {r["root"] for r in rows}}


def by_hand(names, edges):
    """The closest first members first, looked for anew after every merge."""
    clusters = [[n] for n in names]
    while True:
        near = [(-edges.get((a[0], b[0]), edges.get((b[0], a[0]), 0)), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j]
        near = [x for x in near if x[0] < 0]
        if not near:
            return {c[0]: c for c in clusters}
        _, i, j = min(near)
        clusters[i] += clusters.pop(j)


def test_merging_in_rounds_against_one_at_a_time(spark):
    assert grouped(spark, ["a", "b", "c"], {("a", "b"): 0.5, ("b", "c"): 0.9, ("a", "c"): 0.46}) == {"a": ["a", "b", "c"]}
    assert grouped(spark, ["a", "b", "c"], {("b", "c"): 0.9, ("a", "c"): 0.6}) == {"b": ["b", "c"], "a": ["a"]}
    rng = random.Random(3)
    names = [f"n{i}" for i in range(40)]
    edges = {(a, b): rng.choice([0.5, 0.6, 0.7, 0.8]) for a in names for b in names if a < b and rng.random() < 0.08}
    assert grouped(spark, names, edges) == by_hand(names, edges)


def test_common_parts_and_rules(spark):
    rng = random.Random(9)
    for a, b in [("abcabd", "xabdabc"), ("aaaa", "aa"), ("", "x"), *(("".join(rng.choices("ab", k=9)), "".join(rng.choices("ab", k=12))) for _ in range(50))]:
        assert _match_lengths(a, b) == [max(n for n in range(len(a) - i + 1) if a[i : i + n] in b) for i in range(len(a))]
    groups = [["xFooBar", "yFooBaz"], ["ab", "cd"], ["a.b"], ["ProfileX", "ProfileY", "GroupZ"], ["ZzMutation", "QqMutation"], ["+x (y)-#", "+x (y)-z"], ["Zz"], ["Qq", "Qqa"]]
    rows = [(n, g[0], [(0.0, 0, i)] if i else []) for g in groups for i, n in enumerate(g)]
    df = spark.createDataFrame(rows, "name string, root string, path array<struct<far:double,stays:bigint,leaves:bigint>>")
    got = {r["root"]: (r["pattern"], r["category"]) for r in cluster_rules(df).collect()}
    assert got["xFooBar"] == ("FooBa", "nav") and got["ab"] == ("ab|cd", "nav") and got["a.b"] == (r"a\.b", "nav") and got["Zz"] == ("Zz", "nav")
    assert got["Qq"] == ("Qq|Qqa", "nav")
    assert got["ProfileX"] == ("ProfileX|ProfileY|GroupZ", "view") and got["ZzMutation"] == ("Mutation", "act") and re.fullmatch(got["+x (y)-#"][0], "+x (y)-") and got["+x (y)-#"][1] == "nav"


def test_proposals(spark):
    df = spark.createDataFrame([("LongOddTitleQuery",)] * 2 + [("LongOddTitleQueries",)] * 3 + [("Once",), (None,), (" ",)], "friendly string")
    assert [tuple(r) for r in propose_rules(df).collect()] == [("LongOddTitleQuer", "nav", 2, 5, "LongOddTitleQueries")]
    assert propose_rules(df.limit(0)).collect() == []


def test_store(spark, tmp_path):
    store = CaptureStore(spark, str(tmp_path / "s"))
    ev = spark.createDataFrame([("a:1", 0, 5), ("a:1", 1, 7), ("b/2 x", 0, 1)], "capture_id string, seq bigint, ts_us bigint")
    store.ingest(ev)
    store.ingest(ev.where("capture_id = 'a:1' and seq = 1"))
    assert [(r["capture_id"], r["n_events"]) for r in store.captures().collect()] == [("b/2 x", 1), ("a:1", 1)]
    one = store.events("a:1")
    assert [r["seq"] for r in one.collect()] == [1]
    assert "PushedFilters: [IsNotNull(capture_id), EqualTo(capture_id,a:1)]" in one._jdf.queryExecution().toString()
    assert store.events("none") is None and store.events().count() == 2 and CaptureStore(spark, str(tmp_path / "none")).captures().count() == 0


def test_store_versions(spark, tmp_path, monkeypatch):
    """An ingest leaves other files alone, versions are put together, and what nobody names is removed."""
    monkeypatch.setattr(store_module, "PIECES", 3)
    store = CaptureStore(spark, str(tmp_path / "s"), buckets=2)
    want = {}
    for i in range(7):
        caps = [f"c{k}" for k in range(6) if (k + i) % 3 == 0] + ["hot"]
        rows = [(c, s, 10 * i + s) for c in caps for s in range(i + 1)]
        before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s" / "events").rglob("*.parquet")} if i else {}
        store.ingest(spark.createDataFrame(rows, "capture_id string, seq bigint, ts_us bigint"))
        assert all(f.stat().st_mtime_ns == t for f, t in before.items() if f.exists())
        want |= {c: sorted((s, 10 * i + s) for s in range(i + 1)) for c in caps}
        got: dict = {}
        for r in store.events().collect():
            got.setdefault(r["capture_id"], []).append((r["seq"], r["ts_us"]))
        assert {c: sorted(v) for c, v in got.items()} == want
        assert {r["capture_id"]: r["n_events"] for r in store.captures().collect()} == {c: len(v) for c, v in want.items()}
        assert sorted((r["seq"], r["ts_us"]) for r in store.events("hot").collect()) == want["hot"]
    assert max(len(list((tmp_path / "s" / "events").glob(f"v=*/bucket={b}"))) for b in (0, 1)) <= 5


def test_store_buckets(spark, tmp_path, monkeypatch):
    """A join's estimate, the product of its sides, doesn't make a bucket of each capture; a large source makes more."""
    left = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") % 500).alias("capture_id"), F.col("id").alias("seq"), F.col("id").alias("ts_us"))
    right = spark.range(20_000).withColumnRenamed("id", "seq").where("seq < 2000")
    joined = left.join(right, "seq")
    assert estimated_bytes(joined) > 200 * store_module.BUCKET_BYTES and source_bytes(joined) == 320_000
    cached = joined.cache()
    assert source_bytes(cached.where("seq < 5")) == 320_000
    assert source_bytes(joined.localCheckpoint()) >= store_module.UNKNOWN_BYTES
    cached.unpersist()
    for path, events, least, buckets in (("joined", joined, 256 << 20, 64), ("large", left.where("seq < 2000"), 1 << 10, 157), ("rdd", joined.localCheckpoint(), 1 << 10, 64)):
        monkeypatch.setattr(store_module, "BUCKET_BYTES", least)
        store = CaptureStore(spark, str(tmp_path / path))
        store.ingest(events)
        assert store._state()["n_buckets"] == buckets
        assert [tuple(r) for r in store.captures().orderBy("capture_id").collect()] == sorted((f"c{i}", 4, i, i + 1500, "") for i in range(500))


def test_lines_of_a_file_read_in_several_splits(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.ndjson").write_text("".join(f"{i:07d} {'x' * 90}\n" for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        lines = read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
        rows = lines.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("line_id", F.substring("line", 1, 7).cast("int").alias("i")))).alias("r")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2 and all([x["i"] for x in r["r"]] == list(range(40_000)) for r in rows) and len({x["line_id"] for x in rows[0]["r"]}) == 40_000


@pytest.mark.parametrize("block", [4, 4096])
def test_source_repeats_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ndjson, "BLOCK", block)
    rng = random.Random(block)
    rows, t = [], {"a": 0, "b": 0}
    for i in range(500):
        c = rng.choice("aab")
        t[c] += rng.choice([0, 90, 100, 300, -120, 600])
        rows.append((c, i, t[c] * 1000, "r" if rng.random() < 0.97 else "q", "f"))
    last: dict = {}
    want = []
    for c, i, at, r, f in rows:
        if c not in last or last[c][1:] != (r, f) or at - last[c][0] >= 500_000:
            want.append(i)
            last[c] = (at, r, f)
    df = spark.createDataFrame(rows, "capture_id string, line_id bigint, ts_us bigint, route string, friendly string").repartition(4)
    assert sorted(r["line_id"] for r in source_repeats(df).collect()) == want and len(want) < 450
