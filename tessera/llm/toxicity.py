"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training takes at most ``SAMPLE`` labelled rows, half of them of either label if there are so many (those with the
smallest seeded hash, a documented bound). All words of these rows are terms of the vectors. A term weighs
(1 + log of how often the text has it) times its inverse document frequency; terms that speak for a label no more
than chance brings of so many (log-likelihood ratio) weigh ``WEAK`` of that. Examples with equal vectors are merged
into one with counts of both labels. Model and index are bounded by the sample and broadcast.

The index holds postings in blocks of examples, and the largest weight of each term in each block. A text's
neighbours are the ``NEIGHBOURS`` examples of highest cosine: blocks go in the order of their bounds, and those whose bound
is below the k-th best cosine are skipped, which never changes the result. The neighbours' votes, weighted
by cosine and rows, are calibrated: a logistic curve is fitted to the votes that each example gets from the others, every row
weighted by how many labelled rows it stands for. Evidence names the nearest examples with cosine and label counts.

Null and empty texts, and texts without a known word, score like the corpus's share of the label. With no labelled
rows every score is 0, with one label only it is that label. Ties go to the example that comes first in
the index. Repeated rows are scored each, an empty table gives an empty table, very long texts are read whole. Columns
named like the outputs are replaced; all others pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm._blocks import fresh, lean, release, trim_driver
from tessera.llm._text import LOWER, text_bytes, to_bytes, word_bounds, word_hashes

SAMPLE, NEIGHBOURS, BLOCK, COMMON = 4096, 50, 64, 12
#: Weight of a term that speaks for no label, blocks that are scored first, neighbours that are named.
WEAK, FIRST, NAMED = 0.1, 4, 5
#: Texts that are multiplied with the matrix at a time.
AT_ONCE = 64
EDGE = np.frombuffer(b".,;:!?\"'()[]{}|*%&$#-", dtype=np.uint8)
IS_EDGE = np.isin(np.arange(256), EDGE)


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a text's lower-case words without punctuation around them, and how often each is there."""
    b = LOWER[to_bytes(raw)]
    return np.unique(word_hashes(b, *word_bounds(np.where(IS_EDGE[b], np.uint8(32), b))), return_counts=True)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of these ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Unit vectors in blocks: postings by term and vector, and for each term the blocks that have it with the largest weight there.

    Terms that many vectors have (one in ``COMMON``) are rows of a matrix instead: a batch of texts is multiplied with it, and the
    largest product of a block is part of its bound.
    """

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int = BLOCK):
        """rows, terms, weights: the entries of the vectors."""
        self.n, self.block, self.blocks = n, block, -(-n // block)
        many = np.bincount(terms, minlength=n_terms) >= max(2, n / COMMON)
        #: of each term its row in the matrix, or -1
        self.common = np.where(many, np.cumsum(many) - 1, -1)
        here = many[terms]
        self.matrix = np.zeros((int(many.sum()), n))
        self.matrix[self.common[terms[here]], rows[here]] = weights[here]
        rows, terms, weights = rows[~here], terms[~here], weights[~here]
        order = np.lexsort((rows, terms))
        self.rows, self.weights = rows[order].astype(np.int32), weights[order]
        key = terms[order].astype(np.int64) * max(1, self.blocks) + self.rows // block
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        self.first, self.size = at.astype(np.int32), np.diff(np.append(at, len(key))).astype(np.int32)
        self.max = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        self.of_block = (key[at] % max(1, self.blocks)).astype(np.int32)
        self.begin = np.searchsorted(key[at] // max(1, self.blocks), np.arange(n_terms + 1)).astype(np.int32)

    def tops(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (terms, weights) the indices and cosines of the k nearest vectors of positive cosine, nearest first; exact."""
        if not self.n:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in vectors]
        dense = np.zeros((len(vectors), len(self.matrix)))
        for row, (t, w) in zip(dense, vectors, strict=True):
            at = self.common[t]
            row[at[at >= 0]] = w[at >= 0]
        dense = dense @ self.matrix
        return [self._top(t, w, s, k) for (t, w), s in zip(vectors, dense, strict=True)]

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.tops([(terms, weights)], k)[0]

    def _top(self, terms: np.ndarray, weights: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """score: what the common terms give."""
        many = self.begin[terms + 1] - self.begin[terms]
        entry, w = _ranges(self.begin[terms], many), np.repeat(weights, many)
        of_block = self.of_block[entry]
        heads = np.arange(0, self.n, self.block)
        bound = np.maximum.reduceat(score, heads) + np.bincount(of_block, weights=w * self.max[entry], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        done = np.zeros(self.blocks, dtype=bool)

        def add(blocks: np.ndarray) -> None:
            """Adds what the other terms give in these blocks."""
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[blocks] = True
            here = chosen[of_block]
            e = entry[here]
            size = self.size[e]
            places = _ranges(self.first[e], size)
            if len(places):
                score[:] += np.bincount(self.rows[places], weights=np.repeat(w[here], size) * self.weights[places], minlength=self.n)
            done[blocks] = True

        add(order[: FIRST + k // self.block])
        sure = np.repeat(done, self.block)[: self.n]
        known = score[sure]
        floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) > k else 0.0
        rest = order[~done[order]]
        add(rest[(bound[rest] > 0) & (bound[rest] >= floor - 1e-9)])
        near = np.flatnonzero((score > 1e-12) & np.repeat(done, self.block)[: self.n])
        found = score[near].round(12)
        if len(near) > k:
            kept = found >= np.partition(found, len(near) - k)[len(near) - k]
            near, found = near[kept], found[kept]
        best = np.lexsort((near, -found))[:k]
        return near[best], found[best]


class Model:
    """Terms with their weights, the index, and each vector's rows by label, first id and share of the labelled rows."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray, int]], neighbours: int = NEIGHBOURS, stands_for: tuple[float, float] = (1.0, 1.0)):
        """rows: (id, hashes, counts, label); stands_for: how many labelled rows each row of label 0 and 1 stands for."""
        self.k, self.n = neighbours, len(rows)
        label = np.array([y for *_, y in rows], dtype=np.int64)
        share = np.array(stands_for)
        total = np.bincount(label, minlength=2) * share
        self.prior = float(total[1] / total.sum()) if self.n else 0.0
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *(f for _, f, _, _ in rows)])
        many = [len(f) for _, f, _, _ in rows]
        self.terms, at = np.unique(flat, return_inverse=True)
        df = np.bincount(at, minlength=len(self.terms))
        bad = np.bincount(at, weights=np.repeat(label, many), minlength=len(self.terms))
        self.weight = (np.log((1 + self.n) / (1 + df)) + 1) * np.where(self._speaks(df, bad, label), 1.0, WEAK)

        merged: dict[bytes, list] = {}
        for name, f, n, y in rows:
            t, w = self.vector(f, n)
            if len(t):
                slot = merged.setdefault(hashlib.blake2b(t.tobytes() + w.round(9).tobytes(), digest_size=16).digest(), [name, t, w, [0, 0]])
                slot[0] = min(slot[0], name)
                slot[3][y] += 1
        # vectors whose heaviest term is the same stand together, so that blocks have tight bounds
        held = sorted(merged.values(), key=lambda v: (int(v[1][v[2].argmax()]), v[0], v[1].tobytes(), v[2].tobytes()))
        self.names = [v[0] for v in held]
        self.counts = np.array([v[3] for v in held], dtype=float).reshape(-1, 2)
        sizes = [len(v[1]) for v in held]
        joined = lambda i, kind: np.concatenate([np.zeros(0, dtype=kind), *(v[i] for v in held)])
        self.index = BlockMaxIndex(np.repeat(np.arange(len(held)), sizes), joined(1, np.int64), joined(2, float), len(held), len(self.terms))
        self.slope, self.offset = 1.0, 0.0
        self._calibrate(held, share)

    @staticmethod
    def _speaks(df: np.ndarray, bad: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Terms whose log-likelihood ratio chance alone brings to none of so many: about twice the logarithm of their number."""
        n, toxic = len(label), label.sum()
        if not 0 < toxic < n:
            return np.zeros(len(df), dtype=bool)
        rate, odds = bad / df, toxic / n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(bad > 0, bad * np.log(rate / odds), 0) + np.where(df > bad, (df - bad) * np.log((1 - rate) / (1 - odds)), 0)
        return 2 * gain > 2 * np.log(max(len(df), 1)) + 5

    def _calibrate(self, held: list, share: np.ndarray) -> None:
        """Fits slope and offset to the votes that each vector's rows get from all others (Newton's method on smoothed targets)."""
        x, y, w = [], [], []
        for begin in range(0, len(held), AT_ONCE):
            some = held[begin : begin + AT_ONCE]
            near = self.index.tops([(t, v) for _, t, v, _ in some], self.k + 1)
            for i, (found, (_, _, _, own)) in enumerate(zip(near, some, strict=True), begin):
                for label in (0, 1):
                    if own[label] and (odds := self.vote(*found, i, label)) is not None:
                        x.append(odds)
                        y.append(label)
                        w.append(own[label] * share[label])
        x, y, w = (np.array(a, dtype=float) for a in (x, y, w))
        if len(x) == 0 or y.min() == y.max():
            return
        rows = np.array([(w * (y == k)).sum() for k in (0, 1)])
        target = np.where(y == 1, (rows[1] + 1) / (rows[1] + 2), 1 / (rows[0] + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(w * (p - target) * x).sum(), (w * (p - target)).sum()])
            c = w * p * (1 - p)
            h = np.array([[(c * x * x).sum() + 1e-6, (c * x).sum()], [(c * x).sum(), c.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.offset = float(a), float(b)

    def vector(self, f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of distinct word hashes f with counts n, and their weights as a unit vector."""
        if not len(self.terms) or not len(f):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, f), len(self.terms) - 1)
        hit = self.terms[at] == f
        t, w = at[hit], (1 + np.log(n[hit])) * self.weight[at[hit]]
        return t, w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, i: np.ndarray, s: np.ndarray, left_out: int | None = None, label: int = 0) -> float | None:
        """Log-odds of label 1 among the nearest vectors i with cosines s; of these, one row of a vector may be left out."""
        rows = self.counts[i]
        if left_out is not None:
            rows[i == left_out, label] -= 1
            others = rows.sum(1) > 0
            s, rows = s[others][: self.k], rows[others][: self.k]
        votes = (rows * s[:, None]).sum(0)
        if votes.sum() <= 0:
            return None
        # a vote of 1 in all by the sample's own share keeps the odds finite
        prior = self.counts.sum(0) / self.counts.sum()
        return float(np.log((votes[1] + prior[1] + 1e-9) / (votes[0] + prior[0] + 1e-9)))

    def scores(self, texts: list[bytes | None]) -> list[tuple[float, list[tuple[str, float, int, int]]]]:
        """For each text its calibrated chance of label 1, and the nearest examples (id, cosine, rows of label 0, of label 1)."""
        if self.prior in (0.0, 1.0):
            return [(self.prior, []) for _ in texts]
        out = []
        for begin in range(0, len(texts), AT_ONCE):
            vectors = [self.vector(*features(x)) for x in texts[begin : begin + AT_ONCE]]
            for i, s in self.index.tops(vectors, self.k):
                odds = self.vote(i, s) if len(i) else None
                if odds is None:
                    out.append((self.prior, []))
                    continue
                near = [(self.names[j], float(x), int(self.counts[j][0]), int(self.counts[j][1])) for j, x in zip(i[:NAMED].tolist(), s[:NAMED], strict=True)]
                out.append((float(1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -30, 30)))), near))
        return out

    def score(self, raw: bytes | None) -> tuple[float, list[tuple[str, float, int, int]]]:
        return self.scores([raw])[0]


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> Model:
    """Learns from at most ``sample`` labelled rows; rows whose label is neither 0 nor 1, or whose id is null, are not labelled."""
    lean(docs.sparkSession)
    marked = labels.where(labels[label].isin(0, 1) & labels[key].isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).distinct()
    known = docs.where(train) if train is not None else docs
    known = known.select(F.col(key).alias("_k"), text_bytes(known, text).alias("_t"))
    there = known.select("_k").join(marked, "_k").distinct()
    many = {r["_y"]: r["n"] for r in there.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    room = {y: min(many.get(y, 0), max(sample // 2, sample - many.get(1 - y, 0))) for y in (0, 1)}
    # ids of the sample: a bounded number of rows
    chosen = [r for y in (0, 1) for r in there.where(F.col("_y") == y).orderBy(F.xxhash64("_k", F.lit(17)), "_k").limit(room[y]).collect()]
    if not chosen:
        return Model([], neighbours)
    picked = docs.sparkSession.createDataFrame(chosen, there.schema)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [features(x.as_py()) for x in b["_t"]]
            yield pa.RecordBatch.from_arrays([b["name"], pa.array([f.tobytes() for f, _ in pairs], pa.binary()), pa.array([n.astype(np.int64).tobytes() for _, n in pairs], pa.binary()), b["_y"]], names=["name", "f", "n", "y"])
        release()

    # an id may stand for several texts: the first of them by its digest is the example
    texts = known.join(F.broadcast(picked), "_k").groupBy("_k", "_y").agg(F.min_by("_t", F.sha2("_t", 256)).alias("_t")).select(F.col("_k").cast("string").alias("name"), "_t", "_y")
    rows = [(r.name, np.frombuffer(r.f, dtype=np.uint64), np.frombuffer(r.n, dtype=np.int64), r.y) for r in texts.mapInArrow(reduce, "name string, f binary, n binary, y int").toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[3]))
    stands = tuple(many[y] / room[y] if room[y] else 1.0 for y in (0, 1))
    trim_driver(docs.sparkSession)
    model = Model(rows, neighbours, stands)
    del rows
    release()  # the driver's
    return model


EVIDENCE = ArrayType(StructType([StructField("example", StringType()), StructField("cosine", DoubleType()), StructField("label_0", LongType()), StructField("label_1", LongType())]))


def score(docs: DataFrame, model: Model, spark: SparkSession, text: str = "text") -> DataFrame:
    """docs without the text, with score, predicted and evidence: the nearest examples' ids, cosines and label counts."""
    lean(spark)
    rest = [c for c in docs.columns if c not in (text, "score", "predicted", "evidence")]
    (t,) = fresh(docs.columns, "t")
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label_0", pa.int64()), ("label_1", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = m.scores([x.as_py() for x in b[t]])
            near = [[dict(zip(("example", "cosine", "label_0", "label_1"), e, strict=True)) for e in es] for _, es in found]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array([x for x, _ in found], pa.float64()), pa.array([int(x >= 0.5) for x, _ in found], pa.int32()), pa.array(near, kind)], names=[*rest, "score", "predicted", "evidence"])
        release()

    schema = StructType([*(docs.schema[c] for c in rest), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", EVIDENCE)])
    return docs.select(*[F.col(f"`{c}`") for c in rest], text_bytes(docs, text).alias(t)).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, spark: SparkSession, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least ``threshold``; all columns unchanged."""
    lean(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x < threshold for x, _ in held.value.scores([x.as_py() for x in b[text].cast(pa.binary())])], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
