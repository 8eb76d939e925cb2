import json
import random
import re

import numpy as np
import pytest

from seqloom.llm import leakage as L
from seqloom.llm.leakage import PositionalIndex, build_index, leaked, pack, unpack, word_terms
from seqloom.llm.notebook import boundaries, segments


def words(text):
    return re.findall(rb"[0-9a-z]+", text.encode("utf-8", "surrogatepass").lower())


def grams(text, n=13):
    w = re.findall("[0-9A-Za-z]+", text)
    w = [x.lower() for x in w]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


PASSAGE = "Given a partial ledger of hive weight entries from the harbour, write a function named align"
CODE = "def f(x):\n    return x + 1"


def notebook(layout, prose, code, out):
    if layout == "ipynb":
        return json.dumps({"cells": [{"cell_type": "markdown", "source": [prose]}, {"cell_type": "code", "source": code.splitlines(True), "outputs": [{"output_type": "stream", "name": "stdout", "text": out}, {"output_type": "display_data", "data": {"image/png": "iVBO"}}, {"output_type": "error", "traceback": ["a", "b"]}]}, None, {"cell_type": "raw"}]})
    if layout == "percent":
        return f"# %% [markdown]\n# {prose}\n\n# %% In[1]\n{code}\n\n# Out[1]:\n# {out}"
    if layout == "fenced":
        return f"<!-- cell 1 -->\n\n{prose}\n\n<!-- cell 2 -->\n\n```python\n{code}\n```\n\n```text\n{out}\n```"
    return f"[md 1]\n{prose}\n\nIn [1]: {code}\n\nOut[1]:\n{out}"


def test_segments_of_all_layouts():
    for layout in ("ipynb", "percent", "fenced", "prompt"):
        for end in ("\n", "\r\n", "\r"):
            text = notebook(layout, "alpha beta", CODE, "gamma")
            text = text if layout == "ipynb" else "﻿" + text.replace("\n", end)
            for told in (layout, None):
                found = [" ".join(w.decode() for w in words(s)) for s in segments(text, told)]
                assert [f for f in found if f][:3] == ["alpha beta", "def f x return x 1", "gamma"], (layout, end, told)
    assert segments("{broken", "ipynb") == ["{broken"] and segments("plain", None) == ["plain"] and segments("[]", "ipynb") == ["[]"]
    assert len(boundaries(notebook("percent", "a", "b", "c"), "percent")) == 3
    assert words("KK İx Straße_1") == [b"k", b"x", b"stra", b"e", b"1"]


def test_passages_within_one_segment_only(spark):
    half = PASSAGE.split(" from ")
    docs = []
    for i, layout in enumerate(("ipynb", "percent", "fenced", "prompt")):
        docs += [(10 * i, notebook(layout, PASSAGE, CODE, "x"), layout, 1), (10 * i + 1, notebook(layout, "x", CODE, PASSAGE.upper()), layout, 1), (10 * i + 2, notebook(layout, half[0] + " from", half[1], "x"), layout, 1)]
    docs += [(99, None, "percent", 1), (98, "", None, 1), (97, PASSAGE, None, 1), (97, PASSAGE, None, 1)]
    items = spark.createDataFrame([(1, PASSAGE, "x"), (2, PASSAGE + " more words", "x"), (3, "too short", "x"), (4, None, "x"), (None, PASSAGE, "x")], "item_id bigint, text string, doc_id string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, layout string, item_id int").repartition(3)
    want = {(d, i) for d in [0, 1, 10, 11, 20, 21, 30, 31, 97] for i in (1, 2)}
    got = list(map(tuple, leaked(df, items).collect()))
    assert set(got) == want and len(got) == len(want)
    assert set(map(tuple, leaked(df, items, item_words=1).collect())) == want  # in several blocks
    assert leaked(df, items.limit(0)).collect() == [] and leaked(df.limit(0), items).collect() == []


def in_order(doc, wanted, span):
    """Whether the words stand in the document in this order within ``span`` places."""
    for p in (p for p, w in enumerate(doc) if w == wanted[0]):
        q = p
        for w in wanted[1:]:
            q = next((r for r in range(q + 1, min(len(doc), p + span)) if doc[r] == w), None)
            if q is None:
                break
        if q is not None:
            return True
    return False


@pytest.mark.parametrize("block_chars", [1, 1 << 22])
def test_index_against_brute_force(spark, monkeypatch, block_chars):
    monkeypatch.setattr(L, "HOT_POSITIONS", 3)
    rng = random.Random(block_chars)
    vocabulary = [f"w{i}" for i in range(9)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60)), "x") for i in range(60)] + [(7, "w1 w2 w3", "x")]
    items = [(i, text(rng.randrange(2, 9)), "x") for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(3)
    index = build_index(df, layout=None, block_chars=block_chars)
    again = PositionalIndex(spark, index.path)  # another list of items, from the stored postings alone
    for part, of in ((items, index), (items[:5], again)):
        asked = spark.createDataFrame(part, "item_id bigint, text string, doc_id string")
        for slack in (0, 2):
            for most in (10**6, 3) if of is index else (10**6,):
                got = list(map(tuple, of.find(asked, window=3, slack=slack, item_words=most).collect()))
                want = {(d, i) for d, t, _ in docs for i, x, _ in part if any(in_order(t.split(), x.split()[k : k + 3], 3 + slack) for k in range(len(x.split()) - 2))}
                assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        index.find(asked, window=60, slack=5)


def test_frequencies_count_the_whole_index(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "A-c"), (3, None), (4, "")], "doc_id bigint, text string").repartition(3)
    index = build_index(df, layout=None, block_chars=1)
    terms = np.sort(word_terms("a b c d"))
    n = dict(zip(terms.tolist(), index.frequencies(terms).tolist()))
    assert [n[word_terms(w)[0]] for w in "abcd"] == [3, 1, 1, 0]


def test_words_and_posting_lists(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("aB9 _-éß\n") for _ in range(4000))
    for most in (1 << 22, 50):
        monkeypatch.setattr(L, "CUT_BYTES", most)
        terms, names = word_terms(text).tolist(), words(text)
        assert len(terms) == len(names) and len(set(zip(terms, names))) == len(set(names)) == len(set(terms))
    assert len(word_terms("")) == len(word_terms(" -\ud800 ")) == 0
    lists = [sorted(rng.sample(range(rng.choice([9, 300, 10**6, 10**11])), 5)) for _ in range(200)] + [[0]]
    count = np.array(list(map(len, lists)))
    data, size = pack(np.concatenate([np.array(x) for x in lists]), count)
    assert unpack(data, count).tolist() == [v for x in lists for v in x] and size.sum() == len(data)
    at = int(size[:7].sum())
    assert unpack(data[at : at + int(size[7])], count[7:8]).tolist() == lists[7]


def test_near_matches(spark):
    loose = PASSAGE.replace("hive weight", "hive and other weight")
    df = spark.createDataFrame([(1, loose, None), (2, PASSAGE, None), (3, " ".join(reversed(PASSAGE.split())), None)], "doc_id bigint, text string, layout string")
    items = spark.createDataFrame([(1, " ".join(PASSAGE.split()[:13]))], "item_id bigint, text string")
    assert [r[0] for r in leaked(df, items).collect()] == [2]
    assert sorted(r[0] for r in leaked(df, items, slack=2).collect()) == [1, 2]
