"""Shared passages below the line: runs of words that two documents share, wherever lines break.

Every word is hashed. Of each ``least`` words in a row a gram of a quarter of them, the one with the
least hash, is chosen by these words alone, so documents that share them choose the same gram; grams
of a single document rule out all but the words that may be shared. What is left is compared exactly:
every run of ``least`` words around a shared gram names the earliest document that holds it, and goes
from all later ones. So every shared run of ``least`` words is found, at any offset and any number of
times.
Words are kept as 32-bit hashes: runs that differ in one word are taken for equal once in 2**32.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, slices, utf8_view

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n``; the longest table is kept."""
    if len(_POWERS.get(base, ())) <= n:
        _POWERS[base] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])
    return _POWERS[base][: n + 1]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 32-bit hash of each word, the byte it starts at, and the offsets of the rows in words."""
    n = len(data)
    solid = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False  # words end with their row
    starts = np.flatnonzero(solid & ~before)
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & after) + 1
    sums = _sums(_BYTES[data] * _powers(_BASE, n)[:n])
    hashes = mix64((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32), starts, np.searchsorted(starts, offsets)


def window_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each start that has so many, whatever row they are of."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = _sums(mix64(hashes.view(np.uint32).astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n])
    return mix64((sums[size:] - sums[:-size]) * _powers(_INVERSE, n)[: n - size + 1])


def _inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``n`` starts have ``size`` words of their own row."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + size <= ends


def chosen(hashes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of ``least`` words inside a row, the start of the gram each run chooses, and
    the hashes of all grams."""
    gram = max(1, least // 4)
    grams = window_keys(hashes, gram)
    width = least - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    # the least hash of each stretch, the last of equals: whole powers of two, then two that overlap
    at, span = np.arange(len(grams)), 1
    pick = lambda x, y: np.where(grams[y] <= grams[x], y, x)
    while span * 2 <= width:
        at, span = pick(at[:-span], at[span:]), span * 2
    if width > span:
        at = pick(at[: len(at) - (width - span)], at[width - span :])
    runs = np.flatnonzero(_inside(offsets, len(at), least))
    return runs, at[runs], grams


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return np.ascontiguousarray(column.flatten().to_numpy()), offsets - offsets[0]


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column end to end, and the rows' offsets."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw.copy().view(kind), (at - at[0]) // kind().itemsize


def _packed(parts: list[tuple[np.ndarray, np.ndarray]], kind: type) -> pa.Array:
    """A binary column of the numbers of consecutive stretches of rows; arrays of numbers would be
    written and read one number at a time."""
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, kind)
    sizes = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
    offsets = (np.concatenate([[0], np.cumsum(sizes)]) * kind().itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, np.int64)
    sizes = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int64()))


def line_marks(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each line's words, the number of them, and the offsets of the rows in lines."""
    breaks = np.flatnonzero(data == 10)
    ends = np.searchsorted(starts, np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable"))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sums = _sums(mix64(hashes.view(np.uint32).astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(hashes))[: len(hashes)])
    marks = mix64((sums[ends] - sums[begins]) * _powers(_INVERSE, len(hashes))[begins] + (ends - begins).astype(np.uint64))
    return marks.view(np.int64), ends - begins, np.searchsorted(breaks, offsets) + np.arange(len(offsets))


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each of ``n`` rows, and the rows' offsets."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return keys[new], np.searchsorted(rows[new], np.arange(n + 1))


def described(least: int, line_runs):
    """The number of ``words`` of each text; packed ``hashes`` (32 bits) of them, ``sizes`` in words (32)
    and ``marks`` (64) of its lines; and the distinct ``keys`` by which it may be found: those of its
    runs of lines, which are odd, and those of its chosen grams, which are even. Batches have the text
    last; the other columns stay."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8_view(batch.columns[-1])
            parts: list[list] = [[], [], [], []]
            for a, b in slices(offsets, 1 << 18):
                part, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, starts, at = word_hashes(part, rows)
                marks, count, lines = line_marks(part, rows, starts, hashes)
                _, _, of, of_lines = line_runs(marks, count, lines, least)
                _, places, keys = chosen(hashes, at, least)
                places = np.unique(places)
                of_grams = np.searchsorted(at, places, side="right") - 1
                found = np.concatenate([of_lines | 1, keys[places].view(np.int64) & ~1])
                for into, x in zip(parts, ((hashes, at), (count, lines), (marks, lines), _distinct(np.concatenate([of, of_grams]), found, b - a))):
                    into.append(x)
            total = np.concatenate([np.diff(at) for _, at in parts[0]]) if parts[0] else np.zeros(0, np.int64)
            made = [pa.array(total, pa.int64()), _packed(parts[0], np.int32), _packed(parts[1], np.int32), _packed(parts[2], np.int64), _lists(parts[3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "words", "hashes", "sizes", "marks", "keys"])

    return run


def windows(least: int):
    """``key, rid, at`` of each run of ``least`` words that chooses one of its row's shared grams and
    does not lie in lines that go, of ``rid, hashes, words, keys, ranges``."""

    def run(batches):
        for batch in batches:
            hashes, offsets = _numbers(batch.column(1), np.int32)
            count, lines = _numbers(batch.column(2), np.int32)
            keys, bounds = _flat(batch.column(3))
            starts, at, grams = chosen(hashes, offsets, least)
            rows = np.searchsorted(offsets, starts, side="right") - 1
            salt = mix64(np.arange(len(batch), dtype=np.uint64) + np.uint64(1))
            mine = np.repeat(salt, np.diff(bounds)) ^ keys.view(np.uint64)
            hit = np.isin((grams[at] & ~np.uint64(1)) ^ salt[rows], mine)
            ends = np.concatenate([[0], np.cumsum(count)])  # of lines, in words of the batch
            gone = np.zeros(len(hashes) + 1, np.int32)
            for row, ranges in enumerate(batch.column(4).to_pylist()):
                for low, high in zip((ranges or [])[::2], (ranges or [])[1::2]):
                    gone[ends[lines[row] + low]] += 1
                    gone[ends[lines[row] + high]] -= 1
            left = np.concatenate([[0], np.cumsum(np.cumsum(gone)[:-1] == 0)])
            hit &= left[starts + least] > left[starts]
            starts, rows = starts[hit], rows[hit]
            found = window_keys(hashes, least)[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array((starts - offsets[rows]).astype(np.int32))], ["key", "rid", "at"]
            )

    return run
