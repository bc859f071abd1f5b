"""Substring dedup: every window of k words is hashed and counted; repeated windows are removed.

Rabin-Karp hashes of every k-word window are counted in Spark in two passes: the first counts short
hashes of all windows and can only say too often that one repeats; the second counts 128-bit hashes
of those left, so the result is exact up to a collision of both (moduli are prime, so no pattern of words provokes one). Words covered by a repeated
window go; neighbouring windows merge into maximal intervals. Windows never cross documents and are
judged on the input.

Null and empty texts have no words. Texts with fewer than k words keep all. A row that repeats is
another document, so its windows repeat; null ids are like others. Other columns pass through, whatever they are called; columns
named like the outputs are replaced. Very long texts are hashed whole. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import _blocks as B
from tessera.llm._text import to_bytes, window_hashes, word_bounds, word_hashes

BUCKET_BYTES = 6 << 20
LINE = np.array([10], dtype=np.uint8)
PAIR = np.dtype([("lo", "<u8"), ("hi", "<u8")])
#: Places of the table that rules most keys out before they are searched for.
TABLE = 1 << 22


class Windows:
    """The windows of a block's documents: bounds of words, 64-bit hashes and, on demand, 128-bit ones."""

    def __init__(self, texts: pa.ChunkedArray, k: int, buckets: int):
        self.k, self.buckets = k, buckets
        raw = [to_bytes(x.as_py()) for x in texts]
        # all documents of the block at once: a line end between two ends a word and begins none
        self.begins = np.cumsum([0, *(len(b) + 1 for b in raw)])
        self.flat = flat = np.concatenate([np.zeros(0, dtype=np.uint8), *(y for b in raw for y in (b, LINE))])
        self.starts, self.stops = word_bounds(flat)
        of = np.searchsorted(self.begins, self.starts, side="right") - 1
        n_words = np.bincount(of, minlength=len(raw))
        self.first = np.cumsum([0, *n_words.tolist()])
        h = window_hashes(word_hashes(flat, self.starts, self.stops), k)
        self.h = h[of[: len(h)] == of[k - 1 :]] if len(h) else h
        self.ends = np.cumsum([0, *np.maximum(0, n_words - k + 1).tolist()])
        self.key = ((self.h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (self.h & np.uint64(0xFFFFFFFF))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.key, return_counts=True)

    def candidates(self, codes: dict[int, np.ndarray]) -> np.ndarray:
        """Windows whose short hash repeats anywhere."""
        u, _ = self.distinct()  # by sorting: np.unique alone goes through a hash table, at many times the cost
        kept = [u[a:z][codes[bucket]] for bucket, a, z in B.runs((u >> np.uint64(32)).astype(np.int64)) if bucket in codes]
        kept = np.concatenate([*kept, np.zeros(0, dtype=np.uint64)])
        if not len(kept):
            return np.zeros(0, dtype=np.int64)
        # the lower bits of a key are a hash: few keys but those sought pass the table
        there = np.zeros(TABLE, dtype=bool)
        there[kept & np.uint64(TABLE - 1)] = True
        maybe = np.flatnonzero(there[self.key & np.uint64(TABLE - 1)])
        key = self.key[maybe]
        at = np.minimum(np.searchsorted(kept, key), len(kept) - 1)
        return maybe[kept[at] == key]

    def words(self, at: np.ndarray) -> np.ndarray:
        """The first word of each of these windows, counted over the whole block."""
        d = np.searchsorted(self.ends, at, side="right") - 1
        return at + (self.first - self.ends)[d]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows at these places (sorted): only the words that they cover are hashed again, one run after the other."""
        out = np.empty(len(at), dtype=PAIR)
        out["lo"] = self.h[at]
        first = self.words(at)
        needed = np.flatnonzero(covered(first, self.k, len(self.starts)))
        if len(needed):
            second = window_hashes(word_hashes(self.flat, self.starts[needed], self.stops[needed], 1), self.k, 1)
            out["hi"] = second[np.searchsorted(needed, first)]
        return out


def _codes(right: pa.Table, column: str) -> dict[int, np.ndarray]:
    return {b.as_py(): np.frombuffer(c.as_py(), dtype=np.uint8).astype(bool) for b, c in zip(right["_bucket"], right[column], strict=True)}


def _by_bucket(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of bucket and value, how often each occurs, and where each pair given is among them."""
    bucket = (pairs["lo"] >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((pairs["hi"], pairs["lo"], bucket))
    s = pairs[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=bool)
    group = np.cumsum(first) - 1
    back = np.empty(len(s), dtype=np.int64)
    back[order] = group
    return s[first], np.bincount(group) if len(s) else np.zeros(0, dtype=np.int64), back


def dedup(docs: DataFrame, k: int = 35, key: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_removed (long), removed (array of [first, last) word intervals) and kept (binary: the kept words joined by one blank)."""
    docs = docs.drop("n_words", "n_removed", "removed", "kept")
    docs, back = B.shielded(docs, "_t", "_block")
    left, n, total = B.blocked(docs, key, text, block_bytes)
    buckets = max(1, total // BUCKET_BYTES)
    parts = min(buckets, B.MOST_PARTS)

    def send(block: int, t: pa.Table):
        u, c = Windows(t["_t"], k, buckets).distinct()
        for bucket, a, z in B.runs((u >> np.uint64(32)).astype(np.int64)):
            yield {"_block": block, "_bucket": bucket, "keys": B.pack(u[a:z].astype(np.uint32)), "many": B.pack(np.minimum(c[a:z], 2).astype(np.uint32)), "extra": None}

    first = B.count_packed(B.per_block(left, send, B.COUNTED), "<u4", parts)

    def confirm(block: int, t: pa.Table, right: pa.Table):
        w = Windows(t["_t"], k, buckets)
        codes = _codes(right, "codes")
        u, c, _ = _by_bucket(w.pairs(w.candidates(codes)), buckets)
        for bucket, a, z in B.runs(((u["lo"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)):
            yield {"_block": block, "_bucket": bucket, "keys": B.pack(u[a:z]), "many": B.pack(np.minimum(c[a:z], 2).astype(np.uint32)), "extra": B.pack(np.packbits(codes[bucket])) + len(codes[bucket]).to_bytes(8, "little")}

    second = B.count_packed(B.per_block_with(left, first.drop("extra").repartition(min(n, B.MOST_PARTS), "_block"), confirm, B.COUNTED), PAIR, parts)
    names = [c for c in left.columns if c not in ("_t", "_block")]

    def remove(block: int, t: pa.Table, right: pa.Table) -> pa.Table:
        w = Windows(t["_t"], k, buckets)
        short = {b.as_py(): np.unpackbits(np.frombuffer(x.as_py()[:-8], dtype=np.uint8), count=int.from_bytes(x.as_py()[-8:], "little")).astype(bool) for b, x in zip(right["_bucket"], right["extra"], strict=True)}
        at = w.candidates(short)
        u, _, back = _by_bucket(w.pairs(at), buckets)
        code = _codes(right, "codes")
        again = np.concatenate([*(code[bucket] for bucket, _, _ in B.runs(((u["lo"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))), np.zeros(0, dtype=bool)])
        hit = np.zeros(len(w.h), dtype=bool)
        hit[at] = again[back]
        gone = covered(w.words(np.flatnonzero(hit)), k, len(w.starts))
        n_words, n_removed = np.diff(w.first), np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        removed = [intervals(gone[a:z]) if n else [] for n, (a, z) in zip(n_removed.tolist(), pairwise(w.first.tolist()), strict=True)]
        kept = joined(w, ~gone)
        out = t.select(names)
        pairs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("removed", removed, pairs), ("kept", kept, pa.binary())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    fields = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in names)
    return B.per_block_with(left, second.repartition(min(n, B.MOST_PARTS), "_block"), remove, f"{fields}, n_words long, n_removed long, removed array<struct<first:bigint,last:bigint>>, kept binary").withColumnsRenamed(back)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places a run of k from one of the starts covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + k] -= 1
    return np.cumsum(edge)[:n] > 0


def intervals(gone: np.ndarray) -> list[dict]:
    """Maximal runs as [first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"first": a, "last": z} for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]


def joined(w: Windows, stays: np.ndarray) -> list[bytes]:
    """Of each document the words that stay, with one blank between them."""
    starts, stops = w.starts[stays], w.stops[stays]
    ends = np.concatenate([[0], np.cumsum(stays)])[w.first]
    # all but a document's last word take the byte after them along, as a blank
    more = np.ones(len(starts), dtype=np.int64)
    more[ends[1:][np.diff(ends) > 0] - 1] = 0
    edge = np.zeros(len(w.flat) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[stops + more] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = w.flat.copy()
    out[stops[more == 1]] = 32
    out = out[keep]
    at = np.concatenate([[0], np.cumsum(stops - starts + more)])[ends]
    return [out[a:z].tobytes() for a, z in pairwise(at.tolist())]


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
