"""Byte-pair encoding of a corpus by prefix dynamic programming.

For every byte prefix of a piece of text there is exactly one token that ends its encoding.  The
table of these last tokens is filled from left to right: a token ``t`` that starts where a prefix
with last token ``p`` ends becomes the last token of the longer prefix if and only if the pair
``(p, t)`` encodes to itself.  Reading the table backwards from the end gives the encoding; a text
that is appended to or edited keeps the tables of what didn't change (:class:`EncodedText`).

Pieces are what the tokenizer's split pattern cuts.  New pieces of a batch are solved together, in
numpy, one byte position at a time; solved pieces are remembered in a bounded table per worker.

Defined results: null text gives null ids, empty text an empty list.  Ids are those of the ordinary
text, special tokens are never produced.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space as the split pattern means it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Characters taken together; pieces longer than LONG bytes are solved one by one.
BLOCK, LONG = 1 << 22, 64
_NONE = np.int64(1) << 40
_MULT = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Fixed int64 -> int32 map in open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            slot = at[left]
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys``, -1 where there is none."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


class Vocabulary:
    """Merge tables of one rank file: a few MB, bounded by the file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        n = max(self.ranks.values()) + 1
        self.size = np.zeros(n, np.int32)
        self.head, self.tail = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        single = [self.ranks[bytes([i])] for i in range(256)]
        self.bytes_to_id = np.array(single, np.int32)
        self.n_base = max(single) + 1
        if self.n_base != 256:
            raise ValueError("the byte tokens must hold the lowest ranks")
        for token, rank in self.ranks.items():
            self.size[rank] = len(token)
            if len(token) > 1:
                self.head[rank], self.tail[rank] = self._halves(token, rank)
        made = np.flatnonzero(self.head >= 0)
        self.pairs = HashTable((self.head[made].astype(np.int64) << 20) | self.tail[made], made.astype(np.int32))
        self._trie()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: what is left when all earlier merges are done."""
        ranks = self.ranks
        cuts = [(ranks[token[:i]], ranks[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        cuts = [c for c in cuts if max(c) < rank]
        if len(cuts) == 1:
            return cuts[0]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], sys.maxsize), i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _trie(self) -> None:
        step: dict[int, int] = {}
        ends = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for b in token:
                key = (node << 8) | b
                if key not in step:
                    step[key] = len(ends)
                    ends.append(-1)
                node = step[key]
            ends[node] = rank
        keys = np.fromiter(step, np.int64, len(step))
        self.steps, self.ends = HashTable(keys, np.fromiter(step.values(), np.int32, len(step))), np.array(ends, np.int32)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, side by side, encodes to itself.

        The merges of both tokens are undone at their border, latest first; the pair is torn up as
        soon as the parts that touch would have merged earlier than what was just undone.
        """
        good = np.ones(len(left), bool)
        at = np.arange(len(left))
        x, y = left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(left), _NONE)
        while len(at):
            merged = self.pairs.get((x << 20) | y)
            torn = (merged >= 0) & (merged < limit)
            good[at[torn]] = False
            go = ~torn & (np.maximum(x, y) >= self.n_base)
            at, x, y = at[go], x[go], y[go]
            undo_left = x > y
            limit = np.where(undo_left, x, y + 1)
            x, y = np.where(undo_left, self.tail[x], x), np.where(undo_left, y, self.head[y])
        return good

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of ``piece``; ``known`` is the table of an unchanged prefix."""
        n = len(piece)
        steps, pairs = self._dicts()
        child, merged_of, ends, base = steps.get, pairs.get, self.ends, self.n_base
        last = [-1, *(known or [])] + [-1] * (n - len(known or []))
        start = 0 if known is None else max(0, len(known) - int(self.size.max()))

        def fits(x: int, y: int) -> bool:
            limit = 1 << 40
            while merged_of((x << 20) | y, limit) >= limit:
                if x < base and y < base:
                    return True
                if x > y:
                    limit, x = x, int(self.tail[x])
                else:
                    limit, y = y + 1, int(self.head[y])
            return False

        for s in range(start, n):
            node, e = 0, s
            while e < n and (node := child((node << 8) | piece[e], -1)) >= 0:
                e += 1
                if last[e] < 0 and (token := ends[node]) >= 0 and (s == 0 or fits(last[s], int(token))):
                    last[e] = int(token)
        return last[1:]

    def _dicts(self) -> tuple[dict[int, int], dict[int, int]]:
        """The tables as dicts, for single pieces; made in the worker that needs them."""
        if not hasattr(self, "_plain"):
            self._plain = tuple(dict(zip(t.keys[t.keys >= 0].tolist(), t.values[t.keys >= 0].tolist())) for t in (self.steps, self.pairs))
        return self._plain

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_plain"}

    def solve(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece, order from the end, id
        low = 0
        for high in (12, LONG):
            group = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(group):
                found.extend(self._solve_group([pieces[i] for i in group], group, high, counts))
        for i in np.flatnonzero(size > LONG):
            last, ids, e = self.last_tokens(pieces[i]), [], len(pieces[i])
            while e:
                ids.append(last[e - 1])
                e -= int(self.size[last[e - 1]])
            counts[i] = len(ids)
            found.append((np.full(len(ids), i), np.arange(len(ids)), np.array(ids, np.int32)))
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(starts[-1], np.int32)
        for piece, back, token in found:
            out[starts[piece + 1] - 1 - back] = token
        return out, counts

    def _solve_group(self, pieces: list[bytes], rows: np.ndarray, width: int, counts: np.ndarray) -> list:
        order = np.argsort(np.fromiter(map(len, pieces), np.int64, len(pieces)), kind="stable")[::-1]
        pieces, rows = [pieces[i] for i in order], rows[order]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        last = np.full((len(pieces), width + 1), -1, np.int32)
        for s in range(int(size[0])):
            live = np.searchsorted(-size, -s, side="left")  # pieces longer than s come first
            at, node, e = np.arange(live), np.zeros(live, np.int64), s
            while len(at):
                node = self.steps.get((node << 8) | data[at, e])
                go = node >= 0
                at, node, e = at[go], node[go].astype(np.int64), e + 1
                token = self.ends[node]
                hit = token >= 0
                if s:
                    cell = at[hit]
                    fits = self.compatible(last[cell, s], token[hit])
                    last[cell[fits], e] = token[hit][fits]
                else:
                    last[at[hit], e] = token[hit]
                go = size[at] > e
                at, node = at[go], node[go]
        found, at, e, back = [], np.arange(len(pieces)), size.copy(), 0
        while len(at):
            token = last[at, e[at]]
            found.append((rows[at], np.full(len(at), back), token))
            counts[rows[at]] += 1
            e[at] -= self.size[token]
            at, back = at[e[at] > 0], back + 1
        return found


def _number_ranges() -> str:
    """Number characters beside the decimal digits (categories Nl and No), as ranges of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)) in ("Nl", "No")
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Splitter:
    """The split pattern of the vocabulary over the standard library's ``re``."""

    _TAIL = r"|[{s}]+(?![^{s}])|[{s}]+"

    def __init__(self) -> None:
        short = "'(?:s|t|re|ve|m|ll|d)"
        tail = self._TAIL.format(s=SPACES)
        numbers = _number_ranges()
        self.ascii = re.compile(short + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        self.any = re.compile(short + rf"| ?[^\W\d_{numbers}]+| ?[\d{numbers}]+| ?(?:[^{SPACES}\w]|_)+" + tail)
        self.safe = re.compile(r"(?<=[!-~]) (?=[!-~])")

    def blocks(self, text: str) -> Iterator[str]:
        """Cut very long text only before single blanks between visible signs, where a piece always starts."""
        at = 0
        while len(text) - at > 2 * BLOCK:
            cut = self.safe.search(text, at + BLOCK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def pieces(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.any).findall(text)


class _Memory(dict):
    """piece -> number; pieces not seen yet get the next number and wait to be solved."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


class Encoder:
    """Encodes texts; remembers solved pieces up to ``remembered``."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.remembered, self.splitter = vocabulary, remembered, Splitter()
        self._fresh()

    def _fresh(self) -> None:
        self.memory = _Memory()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.empty(max(n, 2 * len(a)), a.dtype)
        b[: len(a)] = a
        return b

    def _learn(self) -> None:
        waiting, self.memory.waiting = self.memory.waiting, []
        if not waiting:
            return
        first, n = len(self.memory) - len(waiting), len(waiting)
        # a piece that is itself a token ends its own prefix: no table is needed
        data = [w.encode("utf-8", "surrogatepass") for w in waiting]
        whole = np.fromiter((self.v.ranks.get(d, -1) for d in data), np.int64, n)
        hard = np.flatnonzero(whole < 0)
        ids, counts = self.v.solve([data[i] for i in hard])
        count = np.ones(n, np.int64)
        count[hard] = counts
        start = np.cumsum(count) - count
        total = int(count.sum())
        block = np.empty(total, np.int32)
        easy = np.flatnonzero(whole >= 0)
        block[start[easy]] = whole[easy]
        block[ragged(start[hard], counts)] = ids
        self.flat = self._grown(self.flat, self.used + total)
        self.start, self.count = self._grown(self.start, first + n), self._grown(self.count, first + n)
        self.flat[self.used : self.used + total] = block
        self.start[first : first + n], self.count[first : first + n] = start + self.used, count
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each text."""
        numbers, per_text = [], np.zeros(len(texts), np.int64)
        out, lengths = [], np.zeros(len(texts), np.int64)
        pending, done = 0, 0
        for i, text in enumerate(texts):
            for block in self.splitter.blocks(text):
                pieces = self.splitter.pieces(block)
                numbers.append(np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces)))
                per_text[i] += len(pieces)
                pending += len(block)
                if pending > BLOCK:
                    done = self._flush(numbers, per_text, done, i, out, lengths)
                    pending = 0
        self._flush(numbers, per_text, done, len(texts) - 1, out, lengths)
        return (np.concatenate(out) if out else np.empty(0, np.int32)), lengths

    def _flush(self, numbers: list, per_text: np.ndarray, first: int, last: int, out: list, lengths: np.ndarray) -> int:
        """Turn the piece numbers gathered since the last call into ids."""
        self._learn()
        all_numbers = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        numbers.clear()
        count = self.count[all_numbers].astype(np.int64)
        out.append(self.flat[ragged(self.start[all_numbers], count)])
        owner = np.repeat(np.arange(first, last + 1), per_text[first : last + 1])
        lengths += np.bincount(owner, count, len(lengths)).astype(np.int64)
        per_text[first : last + 1] = 0
        if len(self.memory) > self.remembered:
            self._fresh()
        return last


class EncodedText:
    """A text with the pieces it splits into and, for each, the table of last tokens.

    Appending to it or editing it splits anew only from the piece before the change until the old and
    the new pieces meet again, and of a piece that changed only what follows its unchanged prefix is
    solved.  The ids are those of encoding the whole text afresh.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = "", splitter: Splitter | None = None):
        self.v, self.splitter = vocabulary, splitter or Splitter()
        self.text, self.pieces, self.tables = "", [], []
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to before ``end``."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("an edit must lie inside the text")
        old_starts = np.cumsum([0, *map(len, self.pieces)])
        # what follows the last visible sign before the change may split otherwise, and so may its own piece
        seen = len(self.text[:start].rstrip())
        first = int(np.searchsorted(old_starts, max(0, seen - 1), side="right")) - 1 if seen else 0
        begin = int(old_starts[first]) if self.pieces else 0
        self.text = self.text[:start] + new + self.text[end:]
        shift, changed_to = start + len(new) - end, start + len(new)
        reach, borders = 256, set(old_starts.tolist())
        while True:
            window = self.text[begin : changed_to + reach]
            found = self.splitter.pieces(window)
            whole = begin + len(window) == len(self.text)
            if not whole:  # the last pieces of a window may go on behind it
                kept = len(window.rstrip())
                ends = np.cumsum(list(map(len, found)))
                found = found[: int(np.searchsorted(ends, kept - 1, side="right"))]
            ends = begin + np.cumsum(list(map(len, found)), dtype=np.int64)
            meet = [i for i, e in enumerate(ends.tolist()) if e >= changed_to and e - shift in borders]
            if meet or whole:
                break
            reach *= 4
        last = meet[0] + 1 if meet else len(found)
        rest = int(np.searchsorted(old_starts, ends[meet[0]] - shift)) if meet else len(self.pieces)
        fresh, old = found[:last], self.pieces[first:rest]
        tables = []
        for i, piece in enumerate(fresh):
            data, known = piece.encode("utf-8", "surrogatepass"), []
            if i < len(old):
                known = self.tables[first + i][: len(os.path.commonprefix([data, old[i].encode("utf-8", "surrogatepass")]))]
            tables.append(known if len(known) == len(data) else self.v.last_tokens(data, known))
        self.pieces[first:rest] = fresh
        self.tables[first:rest] = tables

    def ids(self) -> list[int]:
        """The ids, read backwards from each table's end."""
        out: list[int] = []
        for table in self.tables:
            part, e = [], len(table)
            while e:
                part.append(table[e - 1])
                e -= int(self.v.size[table[e - 1]])
            out += reversed(part)
        return out


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start[i] .. start[i] + count[i]``, one after another."""
    if not len(start):
        return np.empty(0, np.int64)
    ends = np.cumsum(count)
    out = np.arange(ends[-1]) if len(ends) else np.empty(0, np.int64)
    return out + np.repeat(start - (ends - count), count)


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; made once per Python worker."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


_vocabularies: dict[tuple, object] = {}


def share_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """Merge tables built once on the driver and broadcast; their size is bounded by the rank file."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _vocabularies:
        _vocabularies[key] = spark.sparkContext.broadcast(Vocabulary(path))
    return _vocabularies[key]


def encode_column(batch: pa.Array, enc: Encoder) -> pa.Array:
    """A column of texts to a column of id lists; null stays null."""
    texts = batch.to_pylist()
    ids, lengths = enc.encode([t or "" for t in texts])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    kind = pa.list_(pa.int32())
    if offsets[-1] >= 2**31:
        raise ValueError("one Arrow batch holds more than 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts]))
    return out.cast(kind)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row's whole text.

    A map over the scan: nothing is shuffled, extra columns are not read.  Null text gives null ids,
    empty text an empty list; repeated keys and repeated texts give one row each.
    """
    src = df.select(key, text)
    shared = share_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), enc)], [key, "ids"])

    kind = src.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
