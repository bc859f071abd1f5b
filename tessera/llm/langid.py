"""Language identification by multilingual mixture inference.

Each language is a distribution over byte trigrams, counted over all training texts. A text is
a mixture: expectation-maximisation estimates the language proportions that explain its trigrams
best, the languages are ranked by proportion, and the set of the first k that maximises the
likelihood less a penalty for each language (half the logarithm of the trigram count) is kept and
estimated anew. The language of the largest proportion is the prediction, that proportion its score.

Null texts and texts without a letter are `und` with score 0 and no languages; so is everything if
there is nothing to learn from. Rows without text or language teach nothing. Ties go to the
language that sorts first. Very long texts cost time in proportion to their distinct trigrams. Repeated rows are
identified each, and count each in training. Columns named like the outputs are replaced; all others pass through, whatever
they are called. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tessera.llm._blocks import fresh, lean, release
from tessera.llm._text import LOWER, text_bytes, to_bytes

#: Trigrams of one message, change of a proportion at which estimates rest, count of a trigram that a language never showed.
CHUNK, REST, SMOOTH = 1 << 18, 1e-6, 0.05
#: Bytes that no word holds count as a blank, so that junk between words says nothing.
BLANK = np.arange(256, dtype=np.uint8)
BLANK[[i for i in range(128) if not chr(i).isalpha()]] = 32
FOLD = BLANK[LOWER]
#: All trigrams there can be: of blanks, 26 letters and the bytes from 128 on.
KINDS = (1 + 26 + 128) ** 3


def trigrams(raw: bytes | None) -> np.ndarray:
    """The byte trigrams of the text with a blank around it, as numbers, of letters' bytes in part at least."""
    b = FOLD[to_bytes(raw)]
    x = np.concatenate([[32], b, [32]]).astype(np.int64)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
    return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]


class Model:
    """Languages, the trigrams that any showed, and log-probabilities: a row for each language, a column for each trigram and one for all others."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(g for g, _ in counts.values())]))
        table = np.zeros((len(self.names), len(self.grams) + 1))
        for row, name in zip(table, self.names, strict=True):
            g, n = counts[name]
            row[np.searchsorted(self.grams, g)] = n
        self.table = np.log((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * KINDS))

    def languages(self, raw: bytes | None) -> list[tuple[str, float]]:
        g, n = np.unique(trigrams(raw), return_counts=True)
        if not len(g) or not self.names:
            return []
        at = np.searchsorted(self.grams, g)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != g)] = len(self.grams)
        return [(self.names[i], share) for i, share in mixture(at, n.astype(float), self.table)]


def fit(docs: DataFrame, train: Column | None = None, lang: str = "lang", text: str = "text") -> Model:
    """Counts all training texts; the model's size follows the languages and the trigrams there can be."""
    known = docs if train is None else docs.where(train)
    known = known.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), text_bytes(known, text).alias("t"))
    lean(docs.sparkSession)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return g, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(name: str, g: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for c in np.unique(g // CHUNK).tolist():
            here = g // CHUNK == c
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c], pa.int32()), pa.array([g[here].tobytes()], pa.binary()), pa.array([n[here].tobytes()], pa.binary())], names=["l", "c", "g", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for name, t in zip(b["l"].to_pylist(), b["t"], strict=True):
                found.setdefault(name, []).append(np.unique(trigrams(t.as_py()), return_counts=True))
            for name, parts in found.items():
                held[name] = merged([*parts, *([held[name]] if name in held else [])])
            if sum(len(g) for g, _ in held.values()) > 4_000_000:
                for name, x in held.items():
                    yield from rows(name, *x)
                held.clear()
        for name, x in held.items():
            yield from rows(name, *x)
        release()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            parts = [(np.frombuffer(g.as_py(), dtype=np.int64), np.frombuffer(n.as_py(), dtype=np.int64)) for g, n in zip(b["g"], b["n"], strict=True)]
            total = merged([*parts, *([total] if total else [])])
        yield from rows(key[0].as_py(), *total)

    schema = "l string, c int, g binary, n binary"
    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in known.mapInArrow(count, schema).groupBy("l", "c").applyInArrow(add, schema).toLocalIterator():
        counts.setdefault(r.l, []).append((np.frombuffer(r.g, dtype=np.int64), np.frombuffer(r.n, dtype=np.int64)))
    return Model({name: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for name, parts in counts.items()})


def mixture(g: np.ndarray, n: np.ndarray, table: np.ndarray, rest: float = REST) -> list[tuple[int, float]]:
    """The selected languages and their proportions, largest first, for columns g of the table with counts n."""
    logs = table[:, g]
    p = np.exp(logs - logs.max(0))
    total, k = n.sum(), len(table)

    def em(use: np.ndarray) -> tuple[np.ndarray, float]:
        q, share = p[use], np.full(len(use), 1 / len(use))
        while len(use) > 1:
            new = share * (q @ (n / (share @ q))) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < rest:
                break
        return share, float(n @ np.log(share @ q))

    share, _ = em(np.arange(k))
    order = np.argsort(-share.round(9), kind="stable")
    best = None
    for size in range(1, k + 1):
        if size > 1 and share[order[size - 1]] < 1e-9:  # numerically nothing
            break
        w, fit_ = em(order[:size])
        fit_ -= size * 0.5 * np.log(max(total, 2))
        if best is None or fit_ > best[0]:
            best = (fit_, order[:size], w)
    _, use, w = best
    return sorted(((int(i), float(x)) for i, x in zip(use, w, strict=True)), key=lambda z: (-round(z[1], 9), z[0]))


LANGUAGES = ArrayType(StructType([StructField("lang", StringType()), StructField("proportion", DoubleType())]))


def identify(docs: DataFrame, model: Model, spark: SparkSession, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred, score and languages: (lang, proportion), largest first."""
    lean(spark)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "languages")]
    (t,) = fresh(docs.columns, "t")
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = [m.languages(x.as_py()) if x.is_valid else [] for x in b[t]]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in rest), pa.array([f[0][0] if f else "und" for f in found], pa.string()), pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()), pa.array([[{"lang": a, "proportion": s} for a, s in f] for f in found], kind)],
                names=[*rest, "lang_pred", "score", "languages"],
            )
        release()

    schema = StructType([*(docs.schema[c] for c in rest), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", LANGUAGES)])
    read = F.when(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), text_bytes(docs, text))
    return docs.select(*[F.col(f"`{c}`") for c in rest], read.alias(t)).mapInArrow(run, schema)
