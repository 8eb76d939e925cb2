"""Resamples drawn by digest: draw ``r`` takes the places ``p`` from 1 on with the smallest ``md5(r:p)``.

The order depends on nothing but ``r`` and ``p``, so captures share it.  Digests compare by their
first 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

_CHUNK = 65_536
_ORDER: dict[int, np.ndarray] = {}  # by number of draws: the places of the first block, kept per worker


def digests(r: int, low: int, high: int) -> np.ndarray:
    """The digests of draw ``r`` at the places from ``low`` to below ``high``."""
    md5 = hashlib.md5
    return np.frombuffer(b"".join([md5(b"%d:%d" % (r, p), usedforsecurity=False).digest()[:8] for p in range(low, high)]), ">u8").astype(np.uint64)


def order(draws: int, low: int, high: int, most: int) -> np.ndarray:
    """A row of digests for each draw; those of places below ``most`` are remembered."""
    if high > most:
        return np.stack([digests(r, low, high) for r in range(draws)])
    known = _ORDER.get(draws)
    have = 0 if known is None else known.shape[1]
    if have < high:
        width = min(most, max(high, 2 * have))
        more = np.stack([digests(r, have, width) for r in range(draws)])
        known = _ORDER[draws] = more if known is None else np.concatenate([known, more], axis=1)
    return known[:, low:high]


def limit(r: int, n: int, a: int) -> int:
    """The greatest digest that draw ``r`` takes when it takes ``a`` of the places from 1 to below ``n``.

    Only digests near the expected one are held; if it isn't among them, more are.
    """
    share = a / (n - 1)
    reach = 8 * (share * (1 - share) / (n - 1)) ** 0.5 + 8 / (n - 1)
    while True:
        low, high = int(max(0.0, share - reach) * 2**64), min(2**64 - 1, int(min(1.0, share + reach) * 2**64))
        below, near = 0, []
        for p in range(1, n, _CHUNK):
            h = digests(r, p, min(n, p + _CHUNK))
            below += int((h < np.uint64(low)).sum())
            near.append(h[(h >= np.uint64(low)) & (h <= np.uint64(high))])
        held = np.concatenate(near)
        if below < a <= below + len(held):
            return int(np.partition(held, a - below - 1)[a - below - 1])
        reach *= 4


def sums(values: np.ndarray, low: int, draws: int, a: int, limits: np.ndarray | None, most: int) -> np.ndarray:
    """Column sums of ``values`` over the places that each draw takes; row ``i`` stands for place ``low + i``.

    Without ``limits`` the rows are all places there are, ``a`` of which are taken.
    """
    if low == 0:
        low, values = 1, values[1:]
    if not len(values):
        return np.zeros((draws, values.shape[1]), np.int64)
    h = order(draws, low, low + len(values), most)
    if limits is None:
        a = min(a, len(values))
        limits = np.partition(h, a - 1, axis=1)[:, a - 1]
    return np.rint((h <= limits[:, None]).astype(np.float64) @ values.astype(np.float64)).astype(np.int64)
