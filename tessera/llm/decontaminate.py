"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are normalised to letters, digits and single blanks, with A-Z and Latin-1 capitals in lower case. A
benchmark item of m bytes may differ in k = floor(m * RATE) edits. By the q-gram lemma an occurrence
within k edits shares at least m - q + 1 - k * q of the item's q-grams, on diagonals no more than k
apart; so q-grams shared are counted in overlapping bands of diagonals, bands under that bound are
dropped, and the others are verified by an alignment limited to the band. q is eight, or as much less as
keeps the bound at one for a short item. Items under q bytes are matched whole. Nothing is lost within the budget.

The benchmark is cut into blocks of ``BLOCK_BYTES``; each block's index has a bounded size and is
broadcast, and the documents are passed once for each block. Null and empty texts match nothing, null
and empty items are ignored, repeated rows are reported each and rows with a null id like others. Documents are scanned
in full, and hits of a very long one are counted CHUNK at a time. Of equally good places of an item the first
is reported. Empty tables give empty tables. Only the key and the text are read to report, all columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._blocks import lean
from tessera.llm._text import LOWER, text_bytes, to_bytes

Q, RATE, BLOCK_BYTES, BITS, CHUNK = 8, 0.1, 4 << 20, 22, 4 << 20
_keep = np.zeros(256, dtype=bool)
_keep[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
PLAIN = np.where(_keep[LOWER], LOWER, 32).astype(np.uint8)


def normalise(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and their offsets in the text."""
    b = to_bytes(raw)
    upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1  # Latin-1 capitals
    b = PLAIN[b]
    b[upper] += 32
    blank = b == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    b = b[at]
    lo, hi = int(len(b) > 0 and b[0] == 32), len(b) - int(len(b) > 1 and b[-1] == 32)
    return b[lo:hi], at[lo:hi]


def qgrams(b: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes (eight at most) from each position as one number."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([b, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))
    return eight & np.uint64((1 << 8 * q) - 1) if q < 8 else eight.copy()


def slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def align(item: np.ndarray, text: np.ndarray, k: int, lo: int, hi: int) -> tuple[int, int] | None:
    """Least edits that turn item into a part of text, on diagonals lo to hi, and where that part ends; None if over k."""
    m, width = len(item), hi - lo + 1
    padded = np.full(m + width + 1, 256, dtype=np.int16)
    a, z = max(lo, 0), min(hi + m + 1, len(text))
    if z <= a:
        return None
    padded[a - lo : z - lo] = text[a:z]
    step = np.arange(width)
    d = np.zeros(width, dtype=np.int64)
    for i in range(m):
        new = d + (padded[i : i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], d[1:] + 1)
        d = np.minimum.accumulate(new - step)
        d += step
        if i & 7 == 7 and d.min() > k:
            return None
    at = int(d.argmin())
    return (int(d[at]), m + lo + at) if d[at] <= k else None


class Grams:
    """q-grams of some items, and where they stand in them."""

    def __init__(self, items: np.ndarray, texts: list[np.ndarray], k: np.ndarray, q: int):
        self.q, self.k = q, k
        self.least = np.array([len(t) - q + 1 for t in texts], dtype=np.int64) - k * q
        grams = [qgrams(texts[i], q) for i in items.tolist()]
        flat = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(items, [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, dtype=np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.begin, self.n = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[slot(self.grams)] = True
        self.min_least = int(self.least[items].min())

    def bands(self, b: np.ndarray) -> list[tuple[int, int, int]]:
        """Item and diagonals of each band of a normalised text with enough shared q-grams."""
        x = qgrams(b, self.q)
        pos = np.flatnonzero(self.seen[slot(x)])
        if len(pos) < self.min_least:
            return []
        at = np.minimum(np.searchsorted(self.grams, x[pos]), len(self.grams) - 1)
        hit = self.grams[at] == x[pos]
        pos, gram = pos[hit], at[hit]
        if len(pos) < self.min_least:
            return []
        # a strip holds k + 1 diagonals; its number lies between these
        base, span = -len(b) - 2, 2 * len(b) + max(map(int, self.k), default=0) + int(self.place.max()) + 6
        base -= int(self.place.max())
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        n = self.n[gram]
        upto = np.cumsum(n)
        first = 0
        while first < len(pos):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CHUNK, side="right")))
            m = n[first:last]
            entry = np.repeat(self.begin[gram[first:last]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            item = self.item[entry]
            strip = (np.repeat(pos[first:last], m) - self.place[entry]) // (self.k[item] + 1)
            found, many = np.unique(item * span + (strip - base), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, many])).astype(np.int64)
            first = last
        # a band covers two strips of diagonals, its own and the next; bands whose own strip is empty count too
        follows = np.concatenate([keys[1:] == keys[:-1] + 1, [False]])
        both = counts.copy()
        both[:-1][follows[:-1]] += counts[1:][follows[:-1]]
        alone = np.concatenate([[True], ~follows[:-1]])
        keys, both = np.concatenate([keys, keys[alone] - 1]), np.concatenate([both, counts[alone]])
        items = keys // span
        ok = both >= self.least[items]
        return [(int(i), (int(s) + base) * (int(self.k[i]) + 1), (int(s) + base + 2) * (int(self.k[i]) + 1) - 1) for i, s in zip(items[ok], keys[ok] % span, strict=True)]


class Index:
    """One block of the benchmark: its items by the q that they can be found with."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float = RATE):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        m = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.k = np.floor(m * rate).astype(np.int64)
        # m - q + 1 - k q >= 1
        q = np.minimum(Q, m // (self.k + 1))
        whole = (self.k == 0) & (m < Q)
        self.short = np.flatnonzero(whole).tolist()
        if (q[~whole] < 1).any():
            raise ValueError("the rate leaves an item without a q-gram")
        self.parts = [Grams(np.flatnonzero(~whole & (q == size)), self.texts, self.k, int(size)) for size in np.unique(q[~whole]).tolist()]

    def find(self, b: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of the best occurrence of each item in the normalised text b."""
        best: dict[int, tuple[int, int, int]] = {}
        for i in self.short:
            if (at := b.tobytes().find(self.texts[i].tobytes())) >= 0:
                best[i] = (0, at, at + len(self.texts[i]))
        for part in self.parts:
            for i, lo, hi in part.bands(b):
                k, t = int(self.k[i]), self.texts[i]
                if found := align(t, b, k, lo, hi):  # the diagonals of a match are no more than k apart, so one band holds them all
                    edits, end = found
                    head = max(0, end - len(t) - k)
                    back = align(t[::-1], b[head:end][::-1], k, -k, k)
                    start = end - (back[1] if back else len(t))
                    best[i] = min(best.get(i, (k + 1, 0, 0)), (edits, start, end))
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(item, text_bytes(benchmark, text).alias("t")).toLocalIterator():
        b = normalise(r.t)[0]
        if len(b):
            block.append((r[0], b))
            size += len(b)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, rate: float = RATE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: key, item, edits, and the span's byte offsets in the text."""
    lean(spark)
    docs = docs.select(F.col(key).alias("_k"), text_bytes(docs, text).alias("_t"))
    kinds = docs.schema["_k"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = pa.int64() if kinds[1] in ("bigint", "int") else None

    def one(block) -> DataFrame:
        held = spark.sparkContext.broadcast(Index(block, rate))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                rows, out = [], []
                for r, x in enumerate(b["_t"]):
                    plain, at = normalise(x.as_py())
                    for i, edits, s, e in index.find(plain):
                        rows.append(r)
                        out.append((i, edits, int(at[max(0, s)]), int(at[min(len(at), e) - 1]) + 1))
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([b["_k"].take(pa.array(rows, pa.int64())), pa.array(list(cols[0]), item_type), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.int64()), pa.array(list(cols[3]), pa.int64())], names=[key, item, "edits", "span_start", "span_end"])

        return docs.mapInArrow(run, f"`{key}` {kinds[0]}, `{item}` {kinds[1] if item_type is None else 'bigint'}, edits int, span_start bigint, span_end bigint")

    parts = [one(b) for b in _blocks(benchmark, item, item_text)] or [one([])]
    return reduce(DataFrame.unionAll, parts)


def clean(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, rate: float = RATE, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns unchanged."""
    lean(spark)
    out = docs
    for block in _blocks(benchmark, item, item_text):
        held = spark.sparkContext.broadcast(Index(block, rate))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b[text].cast(pa.binary()) if not pa.types.is_binary(b[text].type) else b[text]
                yield b.filter(pa.array([not held.value.find(normalise(x.as_py())[0]) for x in texts], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
