import base64
import os
import random

import numpy as np
import pytest

from seqloom.llm import bpe
from seqloom.llm.bpe import DEFAULT_VOCABULARY, Encoder, HashTable, Vocabulary, encode_corpus, ragged

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    """The same vocabulary in a public library."""
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n\n\n  x", "Hello world's I'll 'd 'S don’t", "a" * 500, " " * 300 + "x" + " " * 70, "=" * 1000 + "\r\n", "日本語テキスト 漢字、かな　全角", "naïve Ünïcode ½ ² Ⅷ ٣٤ ", "   \x1c\x1f\x85 z", "😀👩‍👩‍👧‍👦 flags 🇩🇪",
    "iVBORw0KGgoAAAANSUhEUgAAAAUA" * 40, "<|endoftext|> is plain here", "_snake_case__ x_1 __init__", "tab\t\tend\t", "é combining ො", "x" + "​" * 5 + "y", "﻿BOM", "1234567890" * 30, "lotizustostorarazuralomisesekridwemivostora" * 20,
]


def random_text(rng):
    alphabets = ["abcdefghij ", " \t\n\r", "0123456789", "ABCxyz+/=", "äöüßñ日本", "'std ll", "().,;:_-#", " 　 ²½"]
    return "".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 12))) for a in rng.choices(alphabets, k=rng.randrange(1, 12)))


def split(ids, lengths):
    ends = np.cumsum(lengths)
    return [ids[e - n : e].tolist() for e, n in zip(ends, lengths)]


def test_same_ids_as_the_library(vocabulary, reference):
    rng = random.Random(0)
    texts = [*TEXTS, *(random_text(rng) for _ in range(1500))]
    ids, lengths = Encoder(vocabulary).encode(texts)
    assert split(ids, lengths) == [reference.encode_ordinary(t) for t in texts]


def test_small_memory_blocks_and_repeats(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    rng = random.Random(1)
    texts = [random_text(rng) + " word word " * rng.randrange(30) + random_text(rng) for _ in range(200)] * 2
    ids, lengths = Encoder(vocabulary, remembered=40).encode(texts)
    assert split(ids, lengths) == [reference.encode_ordinary(t) for t in texts]


def test_a_known_prefix_can_be_extended(vocabulary):
    rng = random.Random(2)
    for _ in range(60):
        piece = "".join(rng.choice("abcdehilnorstu") for _ in range(rng.randrange(2, 200))).encode()
        cut = rng.randrange(1, len(piece))
        table = vocabulary.last_tokens(piece)
        assert vocabulary.last_tokens(piece[:cut]) == table[:cut]  # a prefix keeps its table
        assert vocabulary.last_tokens(piece, table[:cut]) == table


def test_appends_and_edits(vocabulary, reference):
    rng = random.Random(11)
    encode = reference.encode_ordinary
    text = bpe.EncodedText(vocabulary)
    whole = ""
    for _ in range(150):
        more = rng.choice([random_text(rng), " ", "\n\n", "s", "'", "x", "  y", "1"])
        if rng.random() < 0.5 or not whole:
            text.append(more)
            whole += more
        else:
            a = rng.randrange(len(whole) + 1)
            b = min(len(whole), a + rng.choice([0, 1, 5, 40]))
            text.edit(a, b, more)
            whole = whole[:a] + more + whole[b:]
        assert text.text == whole and text.ids() == encode(whole)
    long = bpe.EncodedText(vocabulary, "word " * 2000)
    tables = long.tables[:1000] + long.tables[1010:]
    long.edit(5025, 5028, "other")
    assert sum(a is b for a, b in zip(tables, long.tables[:1000] + long.tables[1010:])) >= 1980 and long.ids() == encode(long.text)
    with pytest.raises(ValueError):
        long.edit(5, 4, "")


def test_every_token_is_its_own_encoding(vocabulary):
    tokens = [t for t in vocabulary.ranks if len(t) > 1]
    ids, counts = vocabulary.solve(tokens)
    assert (counts == 1).all() and ids.tolist() == [vocabulary.ranks[t] for t in tokens]


def test_compatible_pairs_encode_to_themselves(vocabulary):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, (2, 3000))
    by_id = {i: t for t, i in vocabulary.ranks.items()}
    want = []
    for x, y in zip(a.tolist(), b.tolist()):
        parts = [bytes([c]) for c in by_id[x] + by_id[y]]
        while True:
            best = min(((vocabulary.ranks[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in vocabulary.ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want.append(parts == [by_id[x], by_id[y]])
    assert vocabulary.compatible(a, b).tolist() == want


def test_hash_table_and_ragged():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000))
    table = HashTable(keys, np.arange(len(keys), dtype=np.int32))
    assert table.get(keys).tolist() == list(range(len(keys))) and (table.get(keys + 2**41) == -1).all()
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ragged(np.array([], np.int64), np.array([], np.int64)).tolist() == []


def test_corpus(spark, reference):
    rows = [(i, t, "x", 1) for i, t in enumerate([*TEXTS, None, TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, key int").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got == {i: None if t is None else reference.encode_ordinary(t) for i, t, *_ in rows}
    assert encode_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"
    assert encode_corpus(df.limit(0)).collect() == []
