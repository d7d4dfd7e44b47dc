"""Vector functions as Spark columns, in double precision."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of md5 (RFC 1321): sines, turns of each step, and which word of the block it takes. Words worked out at a time.
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [t for ts in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in ts * 4]
_TAKES = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
AT_ONCE = 1 << 14
#: Words whose hash a worker remembers, at most about so many.
KNOWN = 1 << 18


def _md5_tails(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last 64 bits of md5 of strings of at most 55 bytes, each one block, all at once."""
    block = np.zeros((len(sizes), 64), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block[row, place] = data[np.repeat(starts, sizes) + place]
    block[np.arange(len(sizes)), sizes] = 0x80
    block[:, 56], block[:, 57] = sizes * 8 & 255, sizes >> 5
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(len(sizes), x) for x in _START)
    for i in range(64):
        mixed = _mix(i // 16, b, c, d)
        mixed += a
        mixed += _SINES[i]
        mixed += words[_TAKES[i]]
        a, d, c, b = d, c, b, b + (mixed << np.uint32(_TURNS[i]) | mixed >> np.uint32(32 - _TURNS[i]))
    return (c + _START[2]).byteswap().astype(np.uint64) << np.uint64(32) | (d + _START[3]).byteswap()


def _mix(part: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d ^ (b & (c ^ d)) if part == 0 else c ^ (d & (b ^ c)) if part == 1 else b ^ c ^ d if part == 2 else c ^ (b | ~d)


def hashes_of(words: list[str]) -> np.ndarray:
    """The last 64 bits of each word's md5, for many words: distinct ones are worked out together."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    _, ends, data = coded.dictionary.buffers()
    n = len(coded.dictionary)
    if not n:
        return np.zeros(0, np.uint64)
    ends, data = np.frombuffer(ends, np.int32)[: n + 1].astype(np.int64), np.frombuffer(data or b"", np.uint8)
    starts, sizes, out = ends[:-1], np.diff(ends), np.zeros(n, np.uint64)
    short = np.flatnonzero(sizes < 56)
    for at in range(0, len(short), AT_ONCE):
        some = short[at : at + AT_ONCE]
        out[some] = _md5_tails(data, starts[some], sizes[some])
    for i in np.flatnonzero(sizes >= 56).tolist():
        out[i] = _tail(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out[coded.indices.to_numpy()]


def _tail(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[-8:])


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = got = _tail(word.encode())
        return got


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    """As :func:`hashes_of`, for few words at a time: worked out once for a word that a worker remembers."""
    if len(_hashes) > KNOWN:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector unchanged."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
