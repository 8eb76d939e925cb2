"""Passages of evaluation items inside a corpus, by a stored, distributed positional inverted index.

:func:`build_index` reads the corpus once and writes its postings: one row for each term and block of
documents, with the term's positions in the block.  Rows are partitioned by term and sorted by it
within a file, so a lookup reads what it asks for; a term that is frequent in its block is spread by
block as well, so that no term, however common, ends in one task or one row.

:meth:`PositionalIndex.find` answers any list of items from these rows, as often as wanted, without
the corpus.  The terms' frequencies over the whole index tell which term of each window of
consecutive item words is the rarest.  The postings of the items' terms come together by block of
documents, and there the list of a window's rarest term, shifted by its place in the window, is
intersected with the shifted lists of the others, rarest first, until the whole phrase stands.  With
a slack the same postings give proximity matches: the words in order, within that many words more.

Terms are kept as fingerprints of 64 bits.  A wrong match would need a whole window of equal
fingerprints of unequal words in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.bpe import ragged
from seqloom.llm.notebook import segments
from seqloom.session import scratch_path

WINDOW = 13
#: Words of items looked up together, characters of documents in one block, and bytes cut into words together.
ITEM_WORDS, BLOCK_CHARS, CUT_BYTES = 1_000_000, 4 << 20, 4 << 20
#: Positions between two segments; a window and its slack must be shorter.
SEGMENT_GAP = 64
#: A term with so many positions in a block is spread by block.
HOT_POSITIONS = 4096


# -- words as fingerprints -------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SIGN = np.zeros(256, np.uint64)  # 0 between words, else a random number for each letter or digit, case aside
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _SIGN[[_c, ord(chr(_c).upper())]] = _mixed(np.array([(_c + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
_FACTOR = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse; kept per worker."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def fingerprints(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(term, byte at which it begins) of each word: a longest run of ASCII letters and digits, case aside."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sign = _SIGN[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], sign != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _power_tables(max(len(data), min(CUT_BYTES, 1 << 16)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sign * up[: len(sign)])])
    value = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return _mixed(value).view(np.int64), start


def word_terms(text: str) -> np.ndarray:
    """The terms of a text in order, cut in stretches of bounded size."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= CUT_BYTES:
        return fingerprints(data)[0]
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + CUT_BYTES)
        while to < len(data) and _SIGN[data[to]] and _SIGN[data[to - 1]]:  # never inside a word
            to += 1
        out.append(fingerprints(data[at:to])[0])
        at = to
    return np.concatenate(out)


# -- posting lists as bytes ------------------------------------------------------------------------------
def pack(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each list): lists of growing numbers, one after another, as gaps of 7 bits a byte."""
    first = np.cumsum(count) - count
    gap = np.diff(values, prepend=0)
    gap[first] = values[first]
    size = np.ones(len(gap), np.int64)
    for bits in range(7, 63, 7):
        more = gap >> bits
        if not more.any():
            break
        size += more > 0
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = size > k
        out[at[here] + k] = ((gap[here] >> (7 * k)) & 127) | ((size[here] > k + 1).astype(np.int64) << 7)
    return out, np.add.reduceat(size, first) if len(first) else size


def unpack(data: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of :func:`pack` again; ``count`` says how many each list has."""
    if not len(data):
        return np.empty(0, np.int64)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    gap = np.add.reduceat((data.astype(np.int64) & 127) << (7 * place), begin)
    total = np.cumsum(gap)
    first = np.cumsum(count) - count
    return total - np.repeat(total[first] - gap[first], count)


# -- building ------------------------------------------------------------------------------------------
def _postings(terms: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, n, packed positions, bytes of each) of the words of a block."""
    order = np.argsort(terms, kind="stable")
    sorted_terms = terms[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]])) if len(terms) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(terms)))
    data, size = pack(position[order], count)
    return sorted_terms[first], count, data, size


def _index(batches: Iterator[pa.RecordBatch], parts_of, kind: pa.DataType, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Posting rows of block after block; the row without a term has the documents and where they begin."""
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(kind)]
    names = ["term", "block", "n", "positions", "docs"]
    terms: list[np.ndarray] = []
    position: list[np.ndarray] = []
    docs: list = []
    begins: list[int] = []
    at, chars = 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        start, size = pack(np.array(begins, np.int64), np.array([len(begins)]))
        yield pa.RecordBatch.from_arrays([pa.array([None], types[0]), pa.array([block]), pa.array([len(docs)]), pa.array([start.tobytes()], types[3]), pa.array([docs], types[4])], names)
        term, n, data, size = _postings(np.concatenate(terms), np.concatenate(position)) if terms else (np.empty(0, np.int64),) * 4
        for lo in range(0, len(term), 50_000):
            hi = min(len(term), lo + 50_000)
            ends = np.concatenate([[0], np.cumsum(size[lo:hi])])
            base = int(size[:lo].sum())
            if ends[-1] >= 2**31:
                raise ValueError("one document has too many words for a block")
            packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[base : base + int(ends[-1])].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(term[lo:hi]), pa.array(np.full(hi - lo, block)), pa.array(n[lo:hi]), packed, pa.nulls(hi - lo, types[4])], names)

    for b in batches:
        ids = b.column(0).to_pylist()
        for doc, *row in zip(ids, *(b.column(i).to_pylist() for i in range(1, b.num_columns))):
            if row[0] is None:
                continue
            docs.append(doc)
            begins.append(at)
            for text in parts_of(*row):
                found = word_terms(text)
                chars += len(text)
                if len(found):
                    terms.append(found)
                    position.append(np.arange(at, at + len(found)))
                    at += len(found) + SEGMENT_GAP
            at += 1  # documents begin at different places, words or not
            if chars >= block_chars:
                yield from flush()
                terms, position, docs, begins, at, chars = [], [], [], [], 0, 0
                block += 1
    if docs:
        yield from flush()


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", layout: str | None = "layout", path: str | None = None, block_chars: int = BLOCK_CHARS) -> PositionalIndex:
    """Index the whole texts of ``docs``; ``path`` is where the postings stay (by default until the driver ends).

    Segments are the cells' sources and outputs by ``layout``, the whole text if ``layout`` is None;
    positions of different segments lie too far apart for a match.  Null texts are in no index,
    documents without words match nothing, repeated rows are indexed each.
    """
    spark = docs.sparkSession
    src = docs.select(doc, text, *([layout] if layout else []))
    kind = src.schema[doc].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.string() if kind.simpleString() == "string" else None
    if arrow is None:
        raise ValueError("document ids must be bigint or string")
    parts_of = segments if layout else (lambda t: [t])
    schema = f"term bigint, block bigint, n bigint, positions binary, docs array<{kind.simpleString()}>"
    rows = src.mapInArrow(lambda it: _index(it, parts_of, arrow, block_chars), schema)
    spread = F.when(F.col("term").isNull() | (F.col("n") >= HOT_POSITIONS), F.col("block")).otherwise(F.lit(-1))
    path = path or scratch_path(spark, "index")
    rows.repartition(F.col("term"), spread).sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return PositionalIndex(spark, path, doc)


# -- looking up ----------------------------------------------------------------------------------------
class Windows:
    """The distinct word windows of a block of items, as numbers of its terms, and the items of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int = WINDOW):
        self.size = size
        self.terms = np.unique(np.concatenate([t for _, t in items])) if items else np.empty(0, np.int64)
        rows, owners = [], []
        for item, terms in items:
            if len(terms) >= size:
                rows.append(np.lib.stride_tricks.sliding_window_view(np.searchsorted(self.terms, terms), size))
                owners.append(np.full(len(terms) - size + 1, item, np.int64))
        every = np.concatenate(rows) if rows else np.empty((0, size), np.int64)
        self.codes, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.empty(0, np.int64))
        pair = np.unique(np.stack([which.ravel(), np.concatenate(owners) if owners else np.empty(0, np.int64)]), axis=1)
        self.items = pair[1]
        self.item_start = np.searchsorted(pair[0], np.arange(len(self.codes) + 1))

    def weigh(self, frequency: np.ndarray) -> None:
        """Order the places of each window by the frequency of their terms in the whole index, rarest
        first, and the windows by their rarest term; windows with a term that the index lacks are out."""
        n = frequency[self.codes]
        live = np.flatnonzero(n.min(axis=1) > 0) if len(n) else np.empty(0, np.int64)
        places = np.argsort(n[live], axis=1, kind="stable")
        rarest = self.codes[live, places[:, 0]]
        by = np.argsort(rarest, kind="stable")
        self.live, self.places = live[by], places[by]
        self.window_start = np.searchsorted(rarest[by], np.arange(len(self.terms) + 1))

    def lookup(self, found: np.ndarray, count: np.ndarray, position: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every match in a block, the position lying in the match.

        ``found`` are the numbers of the terms that the block has, in order, ``count`` their numbers of
        positions and ``position`` these, list after list.
        """
        n = np.zeros(len(self.terms), np.int64)
        n[found] = count
        first = np.cumsum(n) - n
        width = int(position.max(initial=0)) + 2 * SEGMENT_GAP
        key = np.repeat(found, count) * width + position  # all lists as one, in order
        windows = self.window_start[found + 1] - self.window_start[found]
        at = ragged(self.window_start[found], windows)  # windows whose rarest term is here
        rarest = np.repeat(found, windows)
        times = n[rarest]
        w = np.repeat(at, times)
        post = position[ragged(first[rarest], times)]
        if slack:
            return self._near(key, width, first, n, position, w, post, slack)
        start = post - self.places[w, 0]
        for k in range(1, self.size):  # intersect with the shifted list of the next rarest term
            if not len(w):
                break
            place = self.places[w, k]
            want = self.codes[self.live[w], place] * width + start + place
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            ok = (key[i] == want) & (start >= 0)
            start, w = start[ok], w[ok]
        return start, self.live[w]

    def _near(self, key: np.ndarray, width: int, first: np.ndarray, n: np.ndarray, position: np.ndarray, w: np.ndarray, post: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """The tightest ordered stretch around each position of the rarest term, if tight enough."""
        low, high, home = post.copy(), post.copy(), post.copy()
        for k in range(1, self.size):
            for step in (-1, 1):
                if not len(w):
                    break
                place = self.places[w, 0] + step * k
                here = (place >= 0) & (place < self.size)
                term = self.codes[self.live[w], np.clip(place, 0, self.size - 1)]
                if step > 0:
                    i = np.searchsorted(key, term * width + high, side="right")
                    there = (i < first[term] + n[term]) | ~here
                    high = np.where(here, position[np.minimum(i, len(position) - 1)], high)
                else:
                    i = np.searchsorted(key, term * width + low, side="left") - 1
                    there = (i >= first[term]) | ~here
                    low = np.where(here, position[np.maximum(i, 0)], low)
                ok = there & (high - low < self.size + slack)
                low, high, w, home = low[ok], high[ok], w[ok], home[ok]
        return home, self.live[w]


def _search(batches: Iterator[pa.RecordBatch], windows: Windows, slack: int, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Matches of the blocks, whose rows follow one another."""
    held: list[tuple] = []
    current = None

    def search() -> Iterator[pa.RecordBatch]:
        docs = next((h for h in held if h[0] is None), None)
        lists = sorted((h for h in held if h[0] is not None), key=lambda h: h[0])
        if docs is None or not lists:
            return
        term, count = np.array([h[0] for h in lists], np.int64), np.array([h[1] for h in lists], np.int64)
        position = unpack(np.frombuffer(b"".join(h[2] for h in lists), np.uint8), count)
        at, w = windows.lookup(np.searchsorted(windows.terms, term), count, position, slack)
        if not len(at):
            return
        begins = unpack(np.frombuffer(docs[2], np.uint8), np.array([docs[1]]))
        of = np.searchsorted(begins, at, side="right") - 1
        n = windows.item_start[w + 1] - windows.item_start[w]
        pair = np.unique(np.stack([np.repeat(of, n), windows.items[ragged(windows.item_start[w], n)]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(docs[3], kind).take(pa.array(pair[0])), pa.array(pair[1])], names)

    for b in batches:
        block = b.column(1).to_pylist()
        for bl, *row in zip(block, *(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
            if bl != current:
                yield from search()
                held, current = [], bl
            held.append(row)
    yield from search()


def _blocks(items: DataFrame, key: str, text: str, most: int, size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' terms, about ``most`` words at a time; a longer item comes in parts that overlap by a window."""
    block, n = [], 0
    for row in items.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        terms = word_terms(row[1])
        for lo in range(0, max(1, len(terms) - size + 1), max(1, most)):
            block.append((row[0], terms[lo : lo + max(1, most) + size - 1]))
            n += len(block[-1][1])
            if n >= most:
                yield block
                block, n = [], 0
    if block:
        yield block


class PositionalIndex:
    """The stored postings: (term, block, n, positions, docs)."""

    def __init__(self, spark: SparkSession, path: str, doc: str = "doc_id"):
        self.spark, self.path, self.doc = spark, path, doc
        self.rows = spark.read.parquet(path)

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """How often each of the (sorted) terms stands in the whole index."""
        asked = self.spark.createDataFrame(pa.table({"term": terms}))  # as many as a block of items has
        rows = self.rows.select("term", "n").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(terms), np.int64)
        out[np.searchsorted(terms, rows.column("term").to_numpy())] = rows.column("n").to_numpy()
        return out

    def find(self, items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, slack: int = 0, item_words: int = ITEM_WORDS) -> DataFrame:
        """(doc, item): every document with the items of which some ``window`` words stand in one segment.

        Items are looked up in blocks of a bounded number of words; what a block asks for is broadcast.
        Null items and items of fewer words match nothing; repeated rows are reported once.
        """
        if window + slack > SEGMENT_GAP:
            raise ValueError(f"a window with its slack may span {SEGMENT_GAP} words at most")
        kind = self.rows.schema["docs"].dataType.elementType.simpleString()
        arrow = pa.int64() if kind == "bigint" else pa.string()
        schema, names = f"`{self.doc}` {kind}, `{item}` bigint", [self.doc, item]
        out: DataFrame | None = None
        for block in _blocks(items, item, text, item_words, window):
            windows = Windows(block, window)
            windows.weigh(self.frequencies(windows.terms))
            shared = self.spark.sparkContext.broadcast(windows)
            used = np.unique(windows.codes[windows.live])
            asked = self.spark.createDataFrame(pa.table({"term": windows.terms[used]}))
            lists = self.rows.join(F.broadcast(asked), "term", "left_semi").unionByName(self.rows.where("term is null"))
            lists = lists.select("term", "block", "n", "positions", "docs").repartition("block").sortWithinPartitions("block")
            found = lists.mapInArrow(lambda it, s=shared: _search(it, s.value, slack, names, arrow), schema)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], schema) if out is None else out.distinct()


def leaked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", layout: str | None = "layout", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slack: int = 0, item_words: int = ITEM_WORDS) -> DataFrame:
    """Index ``docs`` and find ``items`` in it; see :func:`build_index` and :meth:`PositionalIndex.find`."""
    return build_index(docs, doc, text, layout).find(items, item, item_text, window, slack, item_words)
