"""Vectorised words and word shingles of Arrow texts.

A word is a run of bytes other than space and 0x09 to 0x0D; A-Z count as a-z.
Words and shingles are known by 64-bit hashes.  The words of a whole chunk are
hashed at once, eight bytes at a time, each mixed with what came before; words
of more than 32 bytes, which are few, by BLAKE2b.  (A polynomial modulo 2**64
would not do: words of 1,024 letters built like the Thue-Morse word and its
complement have the same value for any base.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Bytes of a word that are hashed with those of all others.
SHORT = 32
#: The first k bytes of eight, for k from 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _hashes(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each word, which is known by where it begins in the bytes ``low`` and its length."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low),), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        out = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for lane in range(SHORT // 8):
            at = np.flatnonzero((lengths > 8 * lane) & (lengths <= SHORT))
            if len(at) == 0:
                break
            out[at] = mix(out[at] ^ (eight[starts[at] + 8 * lane] & _FIRST[np.minimum(lengths[at] - 8 * lane, 8)]))
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = int.from_bytes(blake2b(low[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    hashes: np.ndarray  #: of all words, in order
    bounds: np.ndarray  #: words bounds[i] to bounds[i + 1] are those of text i
    starts: np.ndarray
    ends: np.ndarray  #: last byte of each word
    data: np.ndarray
    offsets: np.ndarray  #: bytes offsets[i] to offsets[i + 1] are those of text i


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text has a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most or i - at >= 60_000:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def words_of(texts: pa.Array) -> Words:
    data, offsets = raw(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data, offsets)
    inside = ~_GAP[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    hashes = _hashes(_LOWER[data], starts, ends - starts + 1)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle, none give none."""
    hashes, bounds = words.hashes, words.bounds
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for j in range(width):
            rolled += hashes[j : j + len(rolled)] * _PLACES[j]
        rolled = mix(rolled)
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif hi > lo:
                out.append(mix(np.array([(hashes[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64) + _PLACES[32 + hi - lo]], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def suffix_buckets(words: Words, buckets: int) -> np.ndarray:
    """A number below ``buckets`` for each word, from its last three bytes."""
    low, last = _LOWER[words.data], words.ends
    if len(last) == 0:
        return np.zeros(0, np.int64)
    length = last - words.starts
    code = low[last].astype(np.uint64)
    code += np.where(length >= 1, low[np.maximum(last - 1, 0)], 0).astype(np.uint64) << np.uint64(8)
    code += np.where(length >= 2, low[np.maximum(last - 2, 0)], 0).astype(np.uint64) << np.uint64(16)
    with np.errstate(over="ignore"):
        return (mix(code + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
