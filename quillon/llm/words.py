"""Vectorised word kernels: an Arrow column of texts becomes flat arrays of words.

A word of up to eight bytes is hashed by a bijection of its bytes, so such words
of one length never collide; a longer one by xxh3. Short runs of words (shingles,
k-mers) chain their words' hashes through a non-linear mixer. Where runs of words
must be told apart for certain they are named by a cryptographic digest of the
words themselves, 16 bytes of BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

_U = np.uint64
BLOCK_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


@dataclass
class Block:
    """Words of some consecutive texts: ``first[i]:first[i + 1]`` are those of text i, ``cut[i]:cut[i + 1]`` its bytes."""

    row: int
    raw: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = pc.fill_null(column, "") if column.null_count else column
    else:
        column = pc.fill_null(column.cast(pa.string()), "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def _hashed(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word."""
    size = end - start
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = part
    eight = np.ndarray((len(part) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    out = mix(mix(eight[start] & _TAIL[np.minimum(size, 8)]) + size.astype(_U) * _U(0x9E3779B97F4A7C15))
    long_ = np.flatnonzero(size > 8)
    if len(long_):
        data = part.tobytes()
        out[long_] = np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in zip(start[long_].tolist(), end[long_].tolist(), strict=True)), _U, len(long_))
    return out


def blocks(column: pa.Array, *, lower: bool = False) -> Iterator[Block]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (none for null), in blocks of about half a MB; one text is never cut."""
    n = len(column)
    if not n:
        return
    raw, at = _plain(column)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
        part, cut = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        if lower:
            part = _LOWER[part]
        inside = ~_SPACES[part]
        joined = inside.copy()
        joined[1:] &= inside[:-1]
        heads = cut[:-1][cut[:-1] < len(part)]
        joined[heads] = False  # a word never runs over from the text before
        start = np.flatnonzero(inside & ~joined)
        end = np.flatnonzero(inside & ~np.r_[joined[1:], False]) + 1
        yield Block(i, part, cut, np.searchsorted(start, cut), start, end, _hashed(part, start, end))
        i = j


def owners(block: Block) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(block.n_texts), np.diff(block.first))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive hashes, by doubling; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    at, size = hashes, 1
    while size < k:
        step = min(size, k - size)  # the second half may overlap the first: together they still name the run
        at, size = mix(at[: len(at) - step] * _U(0xD1342543DE82EF95) + mix(at[step:] ^ _U(step))), size + step
    return at


def digests(block: Block, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Two longs for each word run [lo, hi), each within one text: the digest of its words parted by one space."""
    size = block.end - block.start
    begins = np.cumsum(size + 1) - size - 1
    text = np.full(len(block.raw) + len(size), 32, np.uint8)
    letters = block.raw[~_SPACES[block.raw]]
    text[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    data = text.tobytes()
    begin, end = begins[lo].tolist(), (begins[hi - 1] + size[hi - 1]).tolist()
    named = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)])
    return np.frombuffer(named, np.int64).reshape(-1, 2)
