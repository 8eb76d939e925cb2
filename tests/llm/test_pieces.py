import json
import random

import pytest

from seqloom.llm.bpe import DEFAULT_VOCABULARY, Encoder, Vocabulary
from seqloom.llm.notebook import boundaries
from seqloom.llm.pieces import Cutter, merge_segments, split_oversized


@pytest.fixture(scope="module")
def enc():
    return Encoder(Vocabulary(DEFAULT_VOCABULARY))


def count(enc, texts):
    return enc.encode(texts)[1].tolist()


def naive_merge(size, strength, room):
    runs = [[i, i] for i in range(len(size))]
    total = lambda r: sum(size[r[0] : r[1] + 1])
    while True:
        pairs = [(strength[b[0]], total(a) + total(b), a[0], k) for k, (a, b) in enumerate(zip(runs, runs[1:])) if total(a) + total(b) <= room]
        if not pairs:
            return [tuple(r) for r in runs]
        k = min(pairs)[3]
        runs[k : k + 2] = [[runs[k][0], runs[k + 1][1]]]


def test_merging_matches_a_naive_search():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randrange(1, 25)
        size, strength = [rng.randrange(1, 9) for _ in range(n)], [rng.randrange(4) for _ in range(n)]
        assert merge_segments(size, strength, 15) == naive_merge(size, strength, 15)


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randrange(1, 9)))
    lines = lambda n: [" ".join(word() for _ in range(rng.randrange(0, 14))) for _ in range(n)]
    yield "\n".join(lines(150)), None
    yield "\r\n".join(lines(150)), "percent"
    yield "\n".join(f"# %% In[{i}]\n" + "\n".join(lines(6)) for i in range(30)), "percent"
    yield json.dumps({"cells": [{"cell_type": "code", "source": [x + "\n" for x in lines(5)]} for _ in range(40)]}), "ipynb"
    yield "x" * 9000, None
    yield "日本" * 1500 + "\n" + "é" * 2000, "prompt"
    yield " " * 3000 + "end", None
    yield "😀\n" * 900, None


def test_pieces(enc):
    cutter = Cutter(enc, 200, 20)
    for text, layout in texts(random.Random(1)):
        ids, n = enc.encode([text])
        if n[0] <= 200:
            continue
        pieces = cutter.cut(text, layout, ids)
        assert "".join(text[o:e] for _, o, e, _ in pieces) == text
        sizes = count(enc, [text[s:e] for s, _, e, _ in pieces])
        assert sizes == [z for *_, z in pieces] and max(sizes) <= 200
        assert pieces[0][0] == 0 and all(s < o for s, o, _, _ in pieces[1:])


def test_cells_stay_whole_where_they_fit(enc):
    cells = [f"# %% In[{i}]\n" + "\n".join(f"value_{i}_{k} = {k}" for k in range(9)) + "\n" for i in range(20)]
    text = "".join(cells)
    ids, _ = enc.encode([text])
    starts = {sum(map(len, cells[:i])) for i in range(len(cells))}
    assert all(o in starts for _, o, _, _ in Cutter(enc, 400, 30).cut(text, "percent", ids))


def test_long_lines_are_cut_at_sentences_and_words(enc):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    inside = lambda t, c: t[c - 1].isalnum() and t[c].isalnum()
    cutter = Cutter(enc, 200, 20)
    for text, at_sentences in ((" ".join(sentence(rng.randrange(4, 12)) for _ in range(60)), True), (sentence(900), False), ("x" * 3000 + " " + sentence(700), False), (json.dumps({"cells": [{"source": [sentence(800)]}]}), False)):
        ids, _ = enc.encode([text])
        cuts = [o for _, o, _, _ in cutter.cut(text, None, ids)[1:]]
        assert len(cuts) > 4 and not [c for c in cuts if inside(text, c) and "x" * 300 not in text[max(0, c - 600) : c + 600]]
        assert not at_sentences or all(text[c - 1] == "." for c in cuts)


def test_tiny_limits_keep_the_limit_or_are_refused(enc):
    text = "".join(chr(0x1F600 + i % 50) for i in range(300)) + " ab" * 50
    ids, _ = enc.encode([text])
    for limit, overlap in ((20, 3), (30, 0), (17, 0)):
        pieces = Cutter(enc, limit, overlap).cut(text, None, ids)
        assert "".join(text[o:e] for _, o, e, _ in pieces) == text and max(count(enc, [text[s:e] for s, _, e, _ in pieces])) <= limit


def test_outputs_and_cells_are_boundaries():
    code = [{"id": f"c{i}", "outputs": [{"text": [f"out {i}"], "output_type": "stream"}, {"data": {"text/plain": ["{", "]"]}}], "metadata": {"cells": [{}]}, "source": ["x = {1: [2]}\n"], "cell_type": "code"} for i in range(40)]
    text = json.dumps({"metadata": {"a": [{"b": 1}]}, "cells": code})
    found = boundaries(text, "ipynb")
    assert len(found) == 120 and all(text[c] == "{" for c in found) and [text[c + 2 : c + 4] for c in found[:3]] == ["id", "te", "da"]
    assert boundaries(text[:-40], "ipynb") == found and boundaries('{"cells": [{"source": "abc', "ipynb") == [11] and boundaries("]}\"", "ipynb") == []
    cell = "<!-- cell {} -->\n\n```python\nx = {}\n```\n\n```text\nout\n```\n\n```text\nmore\n```\n\n"
    text = "".join(cell.format(i, i) for i in range(40)) + "<!-- cell 40 -->\n\nprose\n```\nnot an output\n```\n"
    found = boundaries(text, "fenced")
    assert len(found) == 121 and all(text[c:].startswith(("<!--", "```text")) for c in found)


def test_split(spark, enc):
    big = "\n".join(f"line {i} of many" for i in range(900))
    rows = [(1, big, None, "x"), (2, "short", "percent", "x"), (3, None, None, "x"), (4, "", None, "x"), (5, big, "odd", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, layout string, piece string")
    got = split_oversized(df).orderBy("doc_id", "piece_no").collect()
    assert {r["doc_id"] for r in got} == {1, 5}
    assert all(r["piece_tokens"] <= 2048 and r["piece"] == big[r["start"] : r["end"]] for r in got)
    assert "piece" not in split_oversized(df, with_text=False).columns
    exact = "a b" * 1  # a text of exactly the limit isn't oversized
    n = count(enc, [exact])[0]
    one = spark.createDataFrame([(1, exact)], "doc_id bigint, text string")
    assert split_oversized(one, layout=None, limit=n + 20, overlap=1).count() == 0
    assert split_oversized(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        Cutter(enc, 100, 99)
