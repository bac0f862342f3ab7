"""Whole-column text primitives in numpy, shared by the operators that read every word.

An Arrow string column is one byte buffer plus offsets. Words, their 64-bit hashes and the
hashes of word runs are computed over that buffer at once, so no Python object is made for a
word. Work is cut into blocks of about ``BLOCK_BYTES`` bytes, at document borders, so the
temporary arrays stay small however large an Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document forms a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_POWER = _U(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64
_POWER_INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def salted(salt: int) -> np.uint64:
    """A number to add to hashes, another for each salt."""
    return _U(salt * int(_GOLDEN) & (1 << 64) - 1)


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _GOLDEN)
#: Bytes hashed at once; the tables of powers have one entry more.
_STEP = BLOCK_BYTES // 2
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse for the places of a slice; made once, 8 MB in all."""
    if not _powers:
        for base in (_POWER, _POWER_INVERSE):
            table = np.full(_STEP + 1, base)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def byte_class(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is separator, value of each byte); with ``lower`` A-Z count as a-z in both."""
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    value = _BYTE_VALUE.copy()
    if lower:
        value[65:91], sep[65:91] = _BYTE_VALUE[97:123], sep[97:123]
    return sep, value


#: Word separators x20 and x09-x0D, the ASCII white space.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Everything in ASCII but letters and digits 0-9 does not belong to a word.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Block:
    """Some documents' words.

    ``rows``: indices of the documents in their batch. ``data``: their UTF-8 bytes, one after
    the other, a separator between. ``start``/``end``: byte borders of each word.
    ``hash``: of each word. ``first``: index of each document's first word, with a last entry
    for the end, so that document i has the words first[i] .. first[i + 1] - 1.
    """

    def __init__(self, rows, data, start, end, hash_, first):
        self.rows, self.data, self.start, self.end, self.hash, self.first = rows, data, start, end, hash_, first

    def document(self) -> np.ndarray:
        """For each word, which document of the block it is in."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hash of each word data[start:end]: a polynomial over random byte values, finalised."""
    return stem_hashes(data, start, end, value, ())[0]


def stem_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the words, then of their first n bytes for each n of ``lengths`` (of all of a shorter word).

    Long data is summed in slices, so the temporary arrays don't grow with it.
    """
    out = [np.zeros(len(start), np.uint64) for _ in (0, *lengths)]
    up, down = _power_tables()
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _STEP, "right")))
        lo, hi = int(start[a]), min(int(end[b - 1]), int(start[a]) + _STEP)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        before, scale = total[s], down[s]
        for i, most in enumerate((0, *lengths)):
            till = np.minimum(e, s + most) if most else e
            out[i][a:b] = (total[np.minimum(till, _STEP)] - before) * scale + (till - s).astype(np.uint64)
        for at in range(hi, int(end[b - 1]), _STEP):  # the rest of one longer word
            till = min(at + _STEP, int(end[b - 1]))
            out[0][a:b] += (value[data[at:till]] * up[: till - at]).sum(dtype=np.uint64, keepdims=True) * _U(pow(int(_POWER), at - lo, 1 << 64))
        a = b
    return [mix(x) for x in out]


def blocks(column: pa.Array, separators: bytes = SPACE, lower: bool = False, limit: int = BLOCK_BYTES, first_row: int = 0) -> Iterator[Block]:
    """The column's words, block by block, in row order; nulls and empty texts have none."""
    sep, value = byte_class(separators, lower)
    offsets, raw = buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        lo, hi = int(offsets[a]), int(offsets[b])
        # a separator behind each document keeps words of two documents apart
        data = np.full(hi - lo + b - a, 32, np.uint8)
        place = np.arange(hi - lo) + np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        data[place] = raw[lo:hi]
        del place
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~sep[data]
        change = np.diff(inside)
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        border = offsets[a : b + 1] - lo + np.arange(b - a + 1)
        yield Block(np.arange(a, b) + first_row, data, start, end, word_hashes(data, start, end, value), np.searchsorted(start, border))
        a = b


def run_hashes(hash_: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k following words of the whole array, by doubling; borders are the caller's."""
    n = len(hash_) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, out, done, size = mix(hash_ + salted(salt)), None, 0, 1
    while True:
        if k & size:
            part = have[done : done + n]
            out = part.copy() if out is None else mix(out * _POWER + part)
            done += size
        if done == k:
            return out
        have = mix(have[: len(have) - size] * _GOLDEN + have[size:])
        size *= 2


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a run of k words of one document begins."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    length = np.diff(first)
    has = length >= k
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[:-1][has] + (length[has] - k + 1), -1)
    return np.flatnonzero(np.cumsum(ok)[:total] > 0)
