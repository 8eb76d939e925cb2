"""Oversized texts cut into pieces of a bounded number of tokens, at natural boundaries.

A text is laid out in atomic segments, its lines; a line that is too long alone is cut at the ends of
its sentences, a sentence that is too long between words, and only what has no blank within reach
between tokens.  Between two neighbouring segments lies a boundary: strongest where a cell or an
output begins, then at a blank line, at any other line, at a sentence, at a word, and weakest inside
a word.  All adjacent pairs whose joint size fits wait in a heap, and the pair with the weakest
boundary (then the smallest joint size, then the earliest) is merged first, until no pair fits any
more.  Sizes leave room for the overlap, which is put before each piece but the first: the text of
the last tokens of the piece before it.

Pieces are slices of the text, so cutting is lossless: without the overlaps they join to the text.
The size of every piece, overlap included, is its own number of tokens, counted again at the end; a
limit that can't be kept is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.bpe import DEFAULT_VOCABULARY, Encoder, encoder, share_vocabulary
from seqloom.llm.notebook import boundaries

LIMIT, OVERLAP = 2048, 128
#: Tokens that a piece keeps free: at its ends white space may take other tokens than inside the text.
SPARE = 8
#: Characters at either end of a piece in which a safe place is looked for.
SYNC = 400
_LINE = re.compile(r"\r\n|\r|\n|\\n\", *(?=\")")
_BLANK = re.compile(r"[ \t#]*(?:\r\n|\r|\n)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*(?=\s)|(?<=[。！？])")
_WORD = re.compile(r"(?<=\S)(?=\s)")
INSIDE, WORD, SENTENCE, LINE, BLANK, CELL = range(6)


def merge_segments(size: list[int], strength: list[int], room: int) -> list[tuple[int, int]]:
    """(first, last) segment of every piece; ``strength[i]`` is that of the boundary before segment ``i``.

    Linked list and heap; entries of pairs that changed meanwhile are skipped when they come up.
    """
    n = len(size)
    total, last, prev = list(size), list(range(n)), list(range(-1, n - 1))
    version = [0] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = last[i] + 1
        if j < n and (both := total[i] + total[j]) <= room:
            heapq.heappush(heap, (strength[j], both, i, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = last[i] + 1
        if j >= n or version[i] != vi or version[j] != vj or vi < 0:
            continue
        total[i] += total[j]
        last[i] = last[j]
        version[i] += 1
        version[j] = -1
        if last[i] + 1 < n:
            prev[last[i] + 1] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append((i, last[i]))
        i = last[i] + 1
    return out


class Cutter:
    """Cuts texts of more than ``limit`` tokens; the encoder is the worker's own."""

    def __init__(self, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP):
        if not 0 <= overlap < limit - 2 * SPARE:
            raise ValueError("the overlap must leave room for new tokens")
        self.enc, self.limit, self.overlap = enc, limit, overlap

    def _token_ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The character offset at which each token ends; a token inside a sign counts to where the sign ends."""
        ends = np.cumsum(self.enc.v.size[ids])
        if text.isascii():
            return ends
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.cumsum((data & 0xC0) != 0x80)  # signs begun up to each byte
        return starts[ends - 1]

    def cut(self, text: str, layout: str | None, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(start, own start, end, tokens) of each piece in character offsets; ``start`` is where its overlap begins."""
        ends = self._token_ends(text, ids)
        room = self.limit - self.overlap - SPARE
        while True:
            pieces = self._pieces(text, layout, ends, room)
            sizes = self._counts(text, ends, pieces)
            if sizes.max() <= self.limit:
                return [(*p, int(n)) for p, n in zip(pieces, sizes)]
            if room == 1:
                break
            room = max(1, room - max(SPARE, int(sizes.max()) - self.limit))  # rare: white space that packs worse alone
        # where a limit is close to its overlap, the overlap gives way
        pieces = [(own if n > self.limit else start, own, end) for (start, own, end), n in zip(pieces, sizes)]
        sizes = self._counts(text, ends, pieces)
        if sizes.max() > self.limit:
            raise ValueError(f"{self.limit} tokens are fewer than one sign may take")
        return [(*p, int(n)) for p, n in zip(pieces, sizes)]

    def _counts(self, text: str, ends: np.ndarray, pieces: list[tuple[int, int, int]]) -> np.ndarray:
        """Each piece's own number of tokens.

        Between two single blanks that stand between visible signs a piece's tokens are the text's own,
        whatever surrounds them; only what lies outside is encoded again.
        """
        safe, parts, inner = self.enc.splitter.safe, [], []
        for s, _, e in pieces:
            first = safe.search(text, s + 1, min(e, s + SYNC))
            a = b = e
            if first:
                a = b = first.start()
                for m in safe.finditer(text, max(a, e - SYNC), e):
                    b = m.start()
            parts += [text[s:a], text[b:e]]
            inner.append(int(np.searchsorted(ends, b, side="right") - np.searchsorted(ends, a, side="right")))
        return self.enc.encode(parts)[1].reshape(-1, 2).sum(axis=1) + inner

    def _inside(self, text: str, ends: np.ndarray, lo: int, hi: int, room: int, kind: int) -> list[tuple[int, int]]:
        """(start, strength) of the segments within a stretch that is too long alone, without its own start."""
        if kind == INSIDE:
            first, last = np.searchsorted(ends, (lo, hi), side="right").tolist()
            cuts = [int(c) for c in ends[first + room - 1 : last : room] if lo < c < hi]
            return [(c, INSIDE) for c in cuts]
        cuts = [m.end() for m in (_SENTENCE if kind == SENTENCE else _WORD).finditer(text, lo + 1, hi) if lo < m.end() < hi]
        if kind == WORD and len(cuts) > 1:  # a blank now and then will do
            reach = np.searchsorted(ends, cuts, side="right") // max(1, room // 16)
            cuts = [c for c, r, before in zip(cuts, reach, [-1, *reach[:-1]]) if r != before]
        out: list[tuple[int, int]] = []
        starts = [lo, *cuts]
        count = np.diff(np.searchsorted(ends, [*starts, hi], side="right"))
        for i, (a, n) in enumerate(zip(starts, count)):
            if i:
                out.append((a, kind))
            if n > room:
                out += self._inside(text, ends, a, starts[i + 1] if i + 1 < len(starts) else hi, room, kind - 1)
        return out

    def _pieces(self, text: str, layout: str | None, ends: np.ndarray, room: int) -> list[tuple[int, int, int]]:
        kind = {m.end(): LINE for m in _LINE.finditer(text) if m.end() < len(text)}
        kind.update((c, BLANK) for c in list(kind) if _BLANK.match(text, c))
        kind.update((c, CELL) for c in boundaries(text, layout) if 0 < c < len(text))
        starts = [0, *sorted(kind)]
        count = np.diff(np.searchsorted(ends, [*starts, len(text)], side="right"))  # tokens that end in each
        for i in np.flatnonzero(count > room).tolist():
            kind.update(self._inside(text, ends, starts[i], starts[i + 1] if i + 1 < len(starts) else len(text), room, SENTENCE))
        begin = [0, *sorted(kind)]
        size = np.diff(np.searchsorted(ends, [*begin, len(text)], side="right")).tolist()
        strength = [CELL, *(kind[c] for c in begin[1:])]
        begin.append(len(text))
        out = []
        for a, b in merge_segments(size, strength, room):
            own, end = begin[a], begin[b + 1]
            if end > own:
                out.append((self._overlap_start(ends, own) if out else own, own, end))
        return out

    def _overlap_start(self, ends: np.ndarray, own: int) -> int:
        """Where the last ``overlap`` tokens before ``own`` begin."""
        i = int(np.searchsorted(ends, own, side="right")) - self.overlap
        return int(ends[i - 1]) if i > 0 else 0


def split_oversized(docs: DataFrame, doc: str = "doc_id", text: str = "text", layout: str | None = "layout", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY, with_text: bool = True) -> DataFrame:
    """(doc, n_tokens, piece_no, n_pieces, start, own_start, end, piece_tokens, piece) of every piece of
    every text with more than ``limit`` tokens; offsets count characters.  ``with_text=False`` leaves
    ``piece``, the slice from start to end, out.

    Texts within the limit, null and empty ones give no row.  A map over the scan, without a shuffle.
    """
    src = docs.select(doc, text, *([layout] if layout else []))
    src = src.where(F.octet_length(text) > limit)  # a token has at least one byte
    shared = share_vocabulary(docs.sparkSession, vocabulary)
    kind = src.schema[doc].dataType.simpleString()
    schema = f"`{doc}` {kind}, n_tokens bigint, piece_no int, n_pieces int, start bigint, own_start bigint, end bigint, piece_tokens bigint" + ", piece string" * with_text
    names = [doc, "n_tokens", "piece_no", "n_pieces", "start", "own_start", "end", "piece_tokens", *["piece"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        cutter = Cutter(enc, limit, overlap)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = part.column(1).to_pylist()
                layouts = part.column(2).to_pylist() if layout else [None] * len(texts)
                ids, n = enc.encode(texts)
                first = np.cumsum(n) - n
                rows: list[tuple] = []
                for i in np.flatnonzero(n > limit):
                    t = texts[i]
                    pieces = cutter.cut(t, layouts[i], ids[first[i] : first[i] + n[i]])
                    rows += [(int(i), int(n[i]), k, len(pieces), s, o, e, z, *([t[s:e]] if with_text else [])) for k, (s, o, e, z) in enumerate(pieces)]
                if rows:
                    where, *columns = zip(*rows)
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return src.mapInArrow(run, schema)
