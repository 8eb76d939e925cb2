import collections
import math
import random

import pytest

from seqloom.llm import runs as R
from seqloom.llm import subsequences as Q
from seqloom.llm import vocabulary as V
from seqloom.llm.operations import Operations, letters
from seqloom.llm.runs import agglomerate, collapse_runs, equal_labels
from seqloom.llm.subsequences import frequent_subsequences, spelled
from seqloom.llm.vocabulary import BurstTrie, marked_terms, name_terms, term_counts


def brute_patterns(rows, share, least):
    seqs: dict = {}
    for c, t, s, step in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        seqs.setdefault(c, []).append(step)
    need = max(least, math.ceil(round(share * len(seqs), 9)))
    n: collections.Counter = collections.Counter()
    for s in seqs.values():
        found = set()

        def grow(i, p):
            if len(p) >= 3:
                found.add(p)
            if len(p) < 5:
                for j in range(i + 1, min(len(s), i + 5)):
                    if s[j] not in p:
                        grow(j, (*p, s[j]))

        for i in range(len(s)):
            grow(i, (s[i],))
        n.update(found)
    return {" > ".join(p): k for p, k in n.items() if k >= need}


@pytest.mark.parametrize("chunk", [4096, 20])
def test_patterns_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(Q, "CHUNK", chunk)
    monkeypatch.setattr(Q, "TREE_CANDIDATES", 40)
    monkeypatch.setattr(Q, "PLACES", 50 if chunk < 100 else 1 << 20)
    rng = random.Random(chunk)
    rows = [("hot", rng.randrange(10**6), i, rng.choice("abcdefgh")) for i in range(400)]
    rows += [(f"c{c}", rng.randrange(100), i, rng.choice("abcdefghij")) for c in range(12) for i in range(rng.randrange(10, 40))]
    rows += [(None, 1, 1, "a"), ("c1", None, 99, "a"), ("c1", 5, 98, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "cap string, t bigint, tie bigint, step string, pos string").repartition(4)
    got = {r["pattern"]: r["n_captures"] for r in spelled(frequent_subsequences(df, "cap", "t", "tie", "step", 0.3, 4)).collect()}
    assert got == brute_patterns(rows, 0.3, 4) and got


def test_no_patterns(spark):
    df = spark.createDataFrame([("a", 1, 1, "x")], "cap string, t bigint, tie bigint, step string")
    for d in (df, df.limit(0)):
        assert frequent_subsequences(d, "cap", "t", "tie", "step").collect() == []


def brute_runs(rows, gap):
    by: dict = {}
    for r in rows:
        if None not in r[:3]:
            by.setdefault(r[0], []).append(r)
    out = set()
    for e, rs in by.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        cur = [rs[0]]
        for a, b in zip(rs, rs[1:]):
            if None not in a[3:] and a[3:] == b[3:] and b[1] - a[1] <= gap:
                cur.append(b)
            else:
                out.add((e, cur[0][2], cur[0][1], cur[-1][1], len(cur)))
                cur = [b]
        out.add((e, cur[0][2], cur[0][1], cur[-1][1], len(cur)))
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(3000)]), i, rng.choice(["x", "x", "y", None]), rng.choice(["p", "p", "q"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "e string, t bigint, seq bigint, c string, o string").repartition(5)
    got = list(map(tuple, collapse_runs(df, "e", "t", "seq", ["c", "o"], gap_us=3).collect()))
    assert set(got) == brute_runs(rows, 3) and len(got) == len(set(got))
    one = spark.range(3000).selectExpr("'e' as e", "id as t", "id as seq", "'c' as c", "'o' as o")
    assert [tuple(r) for r in collapse_runs(one, "e", "t", "seq", ["c", "o"]).collect()] == [("e", 0, 0, 2999, 3000)]
    assert collapse_runs(df.limit(0), "e", "t", "seq", ["c", "o"]).collect() == []


def naive_runs(rows, similarity, least, gap):
    """Most similar neighbours first, looked for anew after every merge."""
    out = []
    for e in {r[0] for r in rows}:
        runs = [[r] for r in sorted((r for r in rows if r[0] == e), key=lambda r: r[1:3])]
        while True:
            best = None
            for i, (a, b) in enumerate(zip(runs, runs[1:])):
                wait, alike = b[0][1] - a[-1][1], min(similarity((x[3],), (y[3],)) for x in a for y in b)
                if wait <= gap and alike >= least:
                    same = len({x[3] for x in a + b}) == 1
                    best = min(filter(None, (best, (not same, -alike, wait, R._shuffled(b[0][2]), i))))
            if best is None:
                break
            runs[best[-1] : best[-1] + 2] = [runs[best[-1]] + runs[best[-1] + 1]]
        out += [(e, r[0][2], r[0][1], r[-1][1], len(r)) for r in runs]
    return set(out)


def adjacent_runs(rows, similarity, least, gap):
    """What a plain scan of neighbours would give."""
    out = []
    for e in {r[0] for r in rows}:
        for r in sorted((r for r in rows if r[0] == e), key=lambda r: r[1:3]):
            if out and out[-1][-1][0] == e and r[1] - out[-1][-1][1] <= gap and similarity((r[3],), (out[-1][-1][3],)) >= least:
                out[-1].append(r)
            else:
                out.append([r])
    return {(r[0][0], r[0][2], r[0][1], r[-1][1], len(r)) for r in out}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_graded_runs_against_naive_agglomeration(spark, batch):
    rng = random.Random(batch)
    alike = lambda a, b: 1 - abs(a[0] - b[0]) / 20
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 1, 2, 9])
        rows.append((rng.choice(["hot", "hot", "hot", "b"]), t, i, rng.randrange(20)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "e string, t bigint, seq bigint, x bigint").repartition(5)
        for least in (0.4, 0.7):
            got = list(map(tuple, collapse_runs(df, "e", "t", "seq", ["x"], gap_us=4, similarity=alike, least=least).collect()))
            assert set(got) == naive_runs(rows, alike, least, 4) and len(got) == len(set(got))
            assert set(got) != adjacent_runs(rows, alike, least, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_agglomeration_does_not_drift():
    alike = lambda a, b: 1 - abs(a[0] - b[0])
    chain = [R.Run(i, i, i, 1, ((i / 10,),)) for i in range(11)]
    found = agglomerate(chain, R.Linkage(alike, 0.85, 10))
    assert sum(r.n for r in found) == 11 and len(found) > 1 and all(alike(x, y) >= 0.85 for r in found for x in r.kinds for y in r.kinds)
    assert agglomerate([], R.Linkage(alike, 1.0, 1)) == [] and equal_labels((None, "a"), (None, "a")) == 0.0


def test_waiting_runs_are_few():
    """Only what hangs on the unknown side of a cut waits."""
    rng = random.Random(5)
    alike = lambda a, b: 1 - abs(a[0] - b[0]) / 40
    runs = [R.Run(i, i, i, 1, ((rng.randrange(20),),)) for i in range(5000)]
    runs[0].flags, runs[-1].flags = R.LEFT, R.RIGHT
    found = agglomerate(runs, R.Linkage(alike, 0.6, 1))
    assert sum(1 for r in found if r.flags) < 20 and sum(r.n for r in found) == 5000
    same = [R.Run(i, i, i, 1, (("a",),)) for i in range(5000)]
    same[0].flags, same[-1].flags = R.LEFT, R.RIGHT
    assert len(agglomerate(same, R.Linkage(equal_labels, 1.0, 1))) == 1


def test_operations():
    ops = Operations(["FooBar", "FooBarBaz", "Bar"])
    assert ops.of(" foo_bar-BAZ (retry 2)") == "FooBarBaz" and ops.of("xbary") == "Bar" and ops.of("f1o2oBAR") == "FooBar"
    assert ops.of("None such") == "None such" and ops.of(" ") is None and ops.of(None) is None and ops.of("123") == "123"
    assert Operations([]).of("x") == "x" and letters("Ä-b 1C") == "bc"


def test_terms_of_names():
    assert name_terms("LarchBannerLobbyMutation_v2") == ["larch", "banner", "lobby", "mutation", "v"]
    assert name_terms("HTTPServer éaB ") == ["httpserver", "a", "b"] and name_terms("123") == []


def test_counts_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    texts = [rng.choice([None, " ", "the " + " ".join(rng.choices(words, k=rng.randrange(0, 5)))]) for _ in range(2000)]
    total, records = collections.Counter(), collections.Counter()
    for t in texts:
        if t and t.strip():
            total.update(name_terms(t))
            records.update(set(name_terms(t)))
    full = sum(1 for t in texts if t and t.strip())
    df = spark.createDataFrame([(t, "x") for t in texts], "friendly string, term string").repartition(4)
    for kw in ({}, {"burst": 2, "held": 25}, {"burst": 3, "held": 40, "route_terms": 20}, {"burst": 400, "route_terms": 5}):
        got = {r["term"]: (r["n_total"], r["n_records"]) for r in term_counts(df, "friendly", **kw).collect()}
        assert got == {"": (full, full), **{t: (total[t], records[t]) for t in total}}
    marks = {r["term"]: r["mark"] for r in marked_terms(df, "friendly").collect()}
    assert marks == {t: "rare" if records[t] <= 3 else "common" if records[t] > 0.05 * full else None for t in total}
    assert marked_terms(df.limit(0), "friendly").collect() == []


def flat(trie):
    return [(prefix + e, n, r) for prefix, *columns in trie.subtrees() for e, n, r in zip(*columns)]


def test_trie_bursts():
    trie = BurstTrie(2)
    for t in ("", "a", "ab", "abc", "abd", "abe", "b", "ab"):
        trie.add(t, 2, 1)
    got = flat(trie)
    assert got == sorted(got) and dict((t, (n, r)) for t, n, r in got) == {"": (2, 1), "a": (2, 1), "ab": (4, 2), "abc": (2, 1), "abd": (2, 1), "abe": (2, 1), "b": (2, 1)} and trie.size == 7


def test_subtrees_merge_whatever_their_depth():
    rng = random.Random(2)
    for burst in (1, 3, 50):
        want, merged = collections.Counter(), BurstTrie(burst)
        for depth in (1, 2, 9, 60):
            part = BurstTrie(depth)
            for _ in range(120):
                t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 5)))
                part.add(t, 3, 1)
                want[t] += 1
            for subtree in part.subtrees():
                merged.merge(*subtree)
        assert sorted(flat(merged)) == sorted((t, 3 * n, n) for t, n in want.items()) and merged.size == len(want)


def test_dense_prefixes_are_routed_more_finely(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(400)] + ["zz"]
    df = spark.createDataFrame([(t,) for t in texts], "friendly string").repartition(4)
    tries = V.materialise(df.mapInArrow(lambda it: V._count(it, name_terms, 4, 1000), V._SUBTREE), "t")
    entries = [p + e for p, es, *_ in tries.collect() for e in es]
    dense = V.dense_prefixes(tries, 30)
    every = {t[:k] for t in entries for k in range(len(t) + 1)}
    assert dense == {p for p in every if sum(t.startswith(p) for t in entries) > 30} and "a" in dense and "z" not in dense
