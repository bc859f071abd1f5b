"""Byte-level text kernels shared by the operators: words, rolling hashes, folds.

Everything works on one document's UTF-8 bytes as a numpy array, so memory is bounded by the
longest document, and every hash is the same on every machine and run.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Two seeds and two bases, for two independent 64-bit hashes of words and of windows.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
PRIME = (1 << 61) - 1
BASES = (0x0C5B9A1DD72E8F6B % PRIME, 0x1B03738712FAD5C9 % PRIME)
#: Words longer than this are hashed by a keyed digest, one by one.
LONG_WORD = 64
#: Words and windows that are hashed at a time, so that what lies between stays in the processor's cache.
AT_ONCE = 1 << 14

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for numbers under it."""
    low = U64((1 << 31) - 1)
    ah, al, bh, bl = a >> U64(31), a & low, b >> U64(31), b & low
    mid = al * bh + ah * bl
    return reduced(((ah * bh) << U64(1)) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + al * bl)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**61 - 1, for i < n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << (max(n, 1 << 14) - 1).bit_length()
        out = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = times(p[:done], np.full(done, pow(b, done, PRIME), dtype=np.uint64))
                done *= 2
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def to_bytes(text: bytes | bytearray | None) -> np.ndarray:
    return np.frombuffer(text or b"", dtype=np.uint8)


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs without ASCII white space."""
    if not len(b):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    edge = np.empty(len(b) + 2, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = SPACE[b]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[0::2], at[1::2]


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time go through a bijection; words over LONG_WORD bytes are digested.

    Words of up to eight bytes and equal length never collide.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([b, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(b) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    for i in range(0, len(starts), AT_ONCE):
        out[i : i + AT_ONCE] = _word_hashes(b, eight, starts[i : i + AT_ONCE], ends[i : i + AT_ONCE], which)
    return out


def _word_hashes(b: np.ndarray, eight: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """eight: the eight bytes from each place on."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * U64(0x9E3779B97F4A7C15) ^ U64(SEEDS[which]))
    long = size > LONG_WORD
    rows = np.flatnonzero(~long) if long.any() else np.arange(len(starts))
    done = 0
    while len(rows):
        left = size[rows] - done
        x = eight[starts[rows] + done]
        part = left < 8
        x[part] &= (U64(1) << (left[part].astype(np.uint64) * U64(8))) - U64(1)
        h[rows] = mix((h[rows] ^ x) * U64(0xD6E8FEB86659FD93))
        done += 8
        rows = rows[left > 8]
    for i in np.flatnonzero(long).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8, key=SEEDS[which].to_bytes(8, "little")).digest(), "little")
    return h


def window_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A Rabin-Karp hash modulo 2**61 - 1 of each run of k words, mixed to 64 bits; empty if there are fewer."""
    n = max(0, len(words) - k + 1)
    out = np.empty(n, dtype=np.uint64)
    step = max(AT_ONCE, k)
    for i in range(0, n, step):
        # a window's hash doesn't depend on where it stands
        out[i : i + step] = _window_hashes(words[i : i + step + k - 1], k, which)
    return out


def _window_hashes(words: np.ndarray, k: int, which: int) -> np.ndarray:
    n = len(words) - k + 1
    p, inv = powers(len(words) + 1, BASES[which])
    terms = times(reduced(words), p[: len(words)])
    # prefix sums modulo the prime: halves are summed apart, as they can't overflow under 2**32 words
    c = np.zeros(len(words) + 1, dtype=np.uint64)
    high, low = np.cumsum(terms >> U64(32), dtype=np.uint64), np.cumsum(terms & U64(0xFFFFFFFF), dtype=np.uint64)
    c[1:] = reduced(times(reduced(high), np.full(1, 1 << 32, dtype=np.uint64)) + reduced(low))
    return mix(times(reduced(c[k:] + U64(PRIME) - c[:n]), inv[:n]))


def varints(x: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers under 2**63 as bytes of seven bits, lowest first, the last of each under 128; and where each begins (and the end)."""
    many = np.ones(len(x), dtype=np.int64)
    most = int(x.max(initial=0)).bit_length()
    for k in range(7, most, 7):
        many += x >= 1 << k
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(at[-1], dtype=np.uint8)
    for k in range(int(many.max(initial=0))):
        rows = many > k
        out[at[:-1][rows] + k] = ((x[rows] >> 7 * k) & 127) | np.where(many[rows] > k + 1, 128, 0)
    return out.tobytes(), at


def unvarint(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int((ends - first).max(initial=-1)) + 1):
        there = first + k <= ends
        out[there] |= (raw[first[there] + k] & 127).astype(np.int64) << 7 * k
    return out, ends


def fold(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n (null: null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


def text_bytes(docs: DataFrame, text: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
