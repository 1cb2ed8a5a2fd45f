"""Word shingles of whole texts as 64-bit numbers, computed on the bytes of a batch of texts at once.

A word's number is a polynomial over a random value for each of its bytes, modulo 2^64, and mixed; a shingle's number is a
mixed linear form of its words' numbers. Two different shingles get one number with a probability of about 2^-64, which is taken
as never.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: bytes whose words are numbered together
SEGMENT = 2 << 20
#: bytes between words: blank, tab, line feed, vertical tab, form feed, carriage return
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _tables(gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    value[0x41:0x5B] = value[0x61:0x7B]  # A-Z count as a-z
    gap = np.zeros(256, dtype=bool)
    gap[list(gaps)] = True
    value[gap] = 0
    n = SEGMENT + 1
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    parts = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
    return value, gap, up, down, parts


@functools.cache
def tables(gaps: bytes):
    return _tables(gaps)


def _segments(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about SEGMENT bytes together; a longer row is a range of its own."""
    row = 0
    while row < len(ends) - 1:
        stop = int(np.searchsorted(ends, ends[row] + SEGMENT, side="right")) - 1
        stop = max(stop, row + 1)
        yield row, stop
        row = stop


def _word_numbers(data: np.ndarray, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and start places of the words of some bytes that begin with a gap, at most SEGMENT of them."""
    value, gap, up, down, _ = tables(gaps)
    blank = gap[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    total = np.cumsum(value[data] * up[: len(data)], dtype=np.uint64)
    return mix((total[ends - 1] - total[starts - 1]) * down[starts]), starts


def _long_row(data: np.ndarray, gaps: bytes) -> np.ndarray:
    """Word numbers of one row of any length, cut at gaps; a word over SEGMENT bytes is numbered from its pieces."""
    gap = tables(gaps)[1]
    out, at, blank = [], 0, np.array([32], dtype=np.uint8)
    while at < len(data):
        stop = min(len(data), at + SEGMENT - 1)
        if stop < len(data):
            cuts = np.flatnonzero(gap[data[at:stop]])
            if len(cuts) and cuts[-1] > 0:
                stop = at + int(cuts[-1])
            elif not len(cuts):  # inside one huge word
                nexts = np.flatnonzero(gap[data[stop:]])
                end = stop + int(nexts[0]) if len(nexts) else len(data)
                pieces = [_word_numbers(np.concatenate([blank, data[i : min(end, i + SEGMENT - 1)]]), gaps)[0] for i in range(at, end, SEGMENT - 1)]
                number = np.zeros(1, dtype=np.uint64)
                for piece in pieces:
                    number = mix(number * np.uint64(_BASE) + piece)
                out.append(number)
                at = end
                continue
        out.append(_word_numbers(np.concatenate([blank, data[at:stop]]), gaps)[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def word_numbers(texts: pa.Array, gaps: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of an Arrow string array without nulls, and how many each row has. `gaps` separate words; the blank is one."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    numbers, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    spread = offsets + np.arange(len(offsets))  # with one gap put before each row
    for row, stop in _segments(spread):
        if stop == row + 1 and spread[stop] - spread[row] > SEGMENT:
            words = _long_row(data[offsets[row] : offsets[stop]], gaps)
            counts[row] = len(words)
        else:
            joined = np.insert(data[offsets[row] : offsets[stop]], offsets[row:stop] - offsets[row], 32)
            words, starts = _word_numbers(joined, gaps)
            counts[row:stop] = np.diff(np.searchsorted(starts, spread[row : stop + 1] - spread[row]))
        numbers.append(words)
    return np.concatenate(numbers), counts


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle numbers of each row in ascending order, row after row, and how many each row has.

    A row with fewer words than a shingle has its whole sequence as one; a row without words has none.
    """
    words, counts = word_numbers(texts)
    parts = tables(BLANKS)[4]
    ends = np.cumsum(counts)
    starts = ends - counts
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    forms = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        forms[: max(0, n - k)] += words[k:] * parts[k]
    place = np.arange(n) - starts[row]
    full = place + SHINGLE <= counts[row]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for r in short.tolist():  # at most four words each
        own = words[starts[r] : ends[r]]
        forms[starts[r]] = (own * parts[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    full[starts[short]] = True
    forms, row = mix(forms[full]), row[full]
    order = np.lexsort((forms, row))
    forms, row = forms[order], row[order]
    if len(forms):
        new = np.concatenate([[True], (forms[1:] != forms[:-1]) | (row[1:] != row[:-1])])
        forms, row = forms[new], row[new]
    return forms, np.bincount(row, minlength=len(counts)).astype(np.int64)
