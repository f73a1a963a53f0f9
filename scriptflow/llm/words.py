"""Words of many texts at once, as numpy arrays.

The texts of an Arrow column lie behind each other in one buffer of UTF-8 bytes, so
words are found, lower-cased and hashed without a Python object for each of them.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``; words never cross
texts. A null text has no words. Only A-Z are lower-cased.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(
    1, 2**63, 256, dtype=np.uint64
) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []  # filled where they are needed


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to ``n`` at least."""
    if not _tables or len(_tables[0]) <= n:
        _tables[:] = [_powers(_BASE, n + n // 2), _powers(_INVERSE, n + n // 2)]
    return _tables


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def blocks(column, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` for runs of rows.

    ``offsets`` has one more entry than rows and counts from 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # an empty one stays chunked
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        at = offsets[first : last + 1]
        yield first, last, data[at[0] : at[-1]], at - at[0]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and where they end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    lengths = np.diff(offsets)
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][lengths > 0]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][lengths > 0] - 1] = True
    return np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hashes`` hashes any range of ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _grown(len(data))[0][: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes; equal ranges have equal hashes."""
    inverse = _grown(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """``range_hashes`` of all ranges of ``width`` bytes."""
    out = sums[width:] - sums[:-width]
    out *= _grown(len(sums))[1][: len(out)]
    out += np.uint64(width)
    return mixed(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, lower-cased, and where the words of each text begin
    in that list (one more entry than texts)."""
    starts, ends = word_bounds(data, offsets)
    hashes = range_hashes(prefix_sums(_LOWER[data]), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted set of the hashes of its ``n`` words in a row.

    A text of fewer words has its whole sequence as the only one, and one without
    words has none.
    """
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = mixed(grams) + words[k : len(words) - n + 1 + k]
        grams = mixed(grams)
    else:
        grams = words[:0]
    out = []
    for first, last in zip(at[:-1], at[1:]):
        if last - first >= n:
            out.append(np.unique(grams[first : last - n + 1]))
        elif last > first:
            short = words[first:first+1].copy()
            for k in range(first + 1, last):
                short = mixed(short) + words[k]
            out.append(mixed(short + np.uint64(last - first)))
        else:
            out.append(words[:0])
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]
