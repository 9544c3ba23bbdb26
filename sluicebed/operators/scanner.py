"""Where in a batch of contents the needles of all shapes are: one vectorised pass over the bytes, then a look at each place.

The contents of an Arrow batch lie one after another. Each needle is stood for by its least common pair of bytes; a table of
pairs finds them all at once, and the rest of each needle is compared at the places found. What follows costs as much as there
are places, so the work is linear in bytes and matches, however many an object has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together.
SLICE = 4 << 20
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _common(byte: int) -> int:
    """How common a byte is in text, roughly."""
    c = chr(byte)
    return 4 if c.islower() or c.isspace() else 3 if c.isdigit() else 2 if c.isupper() else 1


class Needles:
    def __init__(self, needles: list[bytes]) -> None:
        self.needles = [np.frombuffer(n, np.uint8) for n in needles]
        self.table = np.zeros(1 << 16, bool)
        self.by_pair: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, n in enumerate(needles):
            k = min(range(len(n) - 1), key=lambda k: (_common(n[k]) + _common(n[k + 1]), k))
            code = n[k] | n[k + 1] << 8
            self.table[code] = True
            self.by_pair[code].append((i, k))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of all needles in order, and which needle is there."""
        at, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, max(len(data) - 1, 0), SLICE):
            part = data[lo : lo + SLICE + 1]
            for first in (0, 1):
                # pairs that start at even or odd places are the same bytes as numbers of 16 bits
                code = np.frombuffer(part[first : first + (len(part) - first) // 2 * 2].tobytes(), "<u2")
                hit = np.flatnonzero(np.take(self.table, code))
                codes = code[hit]
                for pair in np.unique(codes).tolist():
                    places = hit[codes == pair] * 2 + (lo + first)
                    for i, k in self.by_pair[pair]:
                        own, n = places - k, self.needles[i]
                        own = own[(own >= 0) & (own + len(n) <= len(data))]
                        for j, byte in enumerate(n.tolist()):
                            if j not in (k, k + 1) and len(own):
                                own = own[data[own + j] == byte]
                        at.append(own)
                        which.append(np.full(len(own), i))
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.argsort(at, kind="stable")
        return at[order], which[order]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column one after another, and where each value starts and the last ends."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of all maximal runs of letters and digits."""
    on = _LETTERS[data]
    before, after = np.zeros_like(on), np.zeros_like(on)
    before[1:], after[:-1] = on[:-1], on[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before[edges], after[edges - 1] = False, False
    return np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1


def runs(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the maximal runs of letters and digits that have one of the lengths; a value's end ends a run.

    A run of n covers some step of n // 2 from one multiple of it to the next, so only these are tried, a byte at a time, and runs
    are measured around what is left.
    """
    step, far = max(1, min(lengths) // 2), max(lengths) + 1
    at = np.arange(0, max(len(data) - step, 0), step) if min(lengths) > 1 else np.empty(0, np.int64)
    for j in sorted(range(step + 1), key=lambda j: -(j * 7 % (step + 1))):
        at = at[_LETTERS[data[at + j]]]
    if len(at) * 4 * far > len(data) or min(lengths) < 2:
        start, stop = _edges(data, offsets)
    else:
        found = {}
        for p in at.tolist():
            row = int(np.searchsorted(offsets, p, side="right")) - 1
            lo, hi = max(int(offsets[row]), p - far), min(int(offsets[row + 1]), p + step + far)
            near = _LETTERS[data[lo:hi]]
            left, right = np.flatnonzero(~near[: p - lo]), np.flatnonzero(~near[p - lo :])
            found[lo + (int(left[-1]) + 1 if len(left) else 0)] = p + (int(right[0]) if len(right) else hi - p)
        start, stop = np.array(sorted(found), np.int64), np.array([found[k] for k in sorted(found)], np.int64)
    fits = np.isin(stop - start, lengths)
    return start[fits], (stop - start)[fits]


def by_value(at: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, list[int], *tuple[list, ...]]]:
    """(value's number, positions in it, more of each) for each value with places; places that reach beyond their value are left out."""
    row = np.searchsorted(offsets, at, side="right") - 1
    ok = at + sizes <= offsets[np.minimum(row + 1, len(offsets) - 1)]
    row, at, more = row[ok], at[ok], tuple(m[ok] for m in more)
    cuts = np.flatnonzero(np.diff(row)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
        if hi > lo:
            yield int(row[lo]), (at[lo:hi] - offsets[row[lo]]).tolist(), *(m[lo:hi].tolist() for m in more)
