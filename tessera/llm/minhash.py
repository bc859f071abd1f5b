"""Near-duplicate documents by Circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct k-word shingles (the whole sequence if it has fewer words).
Two permutations make all coordinates of its signature: one scatters the shingles, the other is
shifted circularly by one for each coordinate. Coordinates are banded; documents with equal sets
are one node. Then

1. in each band bucket every node is compared with the bucket's pivot, the node that shares most buckets
   with others, and nodes linked so far are joined into components;
2. buckets that still hold several components are joined into groups, and each node of a group is
   compared with one reference node. It has ``inter`` shingles in common with that, and others beside. Two
   nodes share at most the smaller ``inter`` and those others that both have. So a pair must share a
   number of others that follows from its sizes: one among the rarest of both, and enough after it (a prefix
   filter with places, over the others only), or have sizes and ``inter`` that allow a link without any.
   Only pairs of different components that meet these bounds are compared;
3. all links found are joined into components.

So no pair that shares a bucket stays open, while a group of thousands of copies, near ones included,
costs a few comparisons each. Every link is confirmed on full sets. At similarity 0.8 a pair shares no
bucket with a probability of 4e-7.

Equal sets are told by a 128-bit digest of all their shingles. Ids may be of any type that has an order.

Null and empty texts have no shingles and no links. Repeated rows are given each, with one component. Rows that share
an id and differ in text are classed each by its own text. A null id takes part but is never the smallest
of its component (null if there is none). Very long texts only make their own set longer. Other columns are not read, so
their names can't clash. An empty table gives an empty table. Ties for a pivot go to the smaller node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tessera.llm._blocks import cut, lean, release
from tessera.llm._graph import components
from tessera.llm._text import LOWER, mix, text_bytes, to_bytes, window_hashes, word_bounds, word_hashes

BANDS, ROWS = 28, 4
K = BANDS * ROWS
_SHIFTS = np.arange(K, dtype=np.uint32)


def shingles(raw: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the text, lower-cased A-Z."""
    b = LOWER[to_bytes(raw)]
    starts, ends = word_bounds(b)
    words = word_hashes(b, starts, ends)
    if 0 < len(words) < k:
        return window_hashes(words, len(words))
    return np.unique(window_hashes(words, k))


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of the shifted second permutation over the set, for each of K shifts."""
    x = (mix(s ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 512):
        y = x[a : a + 512, None] + _SHIFTS
        y *= np.uint32(0x9E3779B1)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x85EBCA77)
        np.minimum(out, y.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, j])
    return h.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """_id, n_shingles, a digest of the set, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sets, bands = [], [], []
            for x in b["_t"]:
                s = shingles(x.as_py(), k)
                n.append(len(s))
                sets.append(_digest(s))
                bands.append(band_keys(signature(s)).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["_id", "n_shingles", "_set", "_bands"])
        release()

    docs = docs.select(F.col(key).alias("_id"), text_bytes(docs, text).alias("_t"))
    schema = StructType([docs.schema["_id"], StructField("n_shingles", LongType()), StructField("_set", BinaryType()), StructField("_bands", ArrayType(LongType()))])
    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """id and packed full set of the nodes (id, _id, _set), from the documents (_id, _t) that have their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), k) for x in b["_t"]]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_set", "set"])
        release()

    asked = nodes.select(F.col("_id").alias("_asked")).distinct()
    made = docs.join(asked, docs["_id"].eqNullSafe(asked["_asked"]), "left_semi").select("_t").mapInArrow(run, "_set binary, set binary")
    return made.dropDuplicates(["_set"]).join(nodes.select("id", "_set"), "_set").select("id", "set")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                s, t = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    ok.append(False)
                    continue
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _split(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    return rows.join(rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket"), "bucket")


def _against_reference(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes (grp, id, comp, ref) with n, inter (shingles shared with the reference), mask (a bit for each shingle of the reference) and others (those it lacks).

    mask and others are the full set, in a fifth of the room for near copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, inter, others, mask = [], [], [], []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                s, t = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                there = t[at] == s
                bits = np.zeros(len(t), dtype=bool)
                bits[at[there]] = True
                mask.append(np.packbits(bits).tobytes())
                n.append(len(s))
                inter.append(int(there.sum()))
                others.append(s[~there].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch["grp"], batch["id"], batch["comp"], pa.array(n, pa.int64()), pa.array(inter, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(mask, pa.binary())], names=["grp", "id", "comp", "n", "inter", "others", "mask"])

    both = nodes.join(sets.select(F.col("id").alias("ref"), F.col("set").alias("y")), "ref").join(sets.select("id", F.col("set").alias("x")), "id")
    return both.select("grp", "id", "comp", "x", "y").mapInArrow(run, "grp long, id long, comp long, n long, inter long, others array<long>, mask binary")


def _confirmed_in_group(pairs: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """_confirmed for pairs of one group, from its nodes' masks and other shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y, p, q in zip(batch["n"].to_pylist(), batch["m"].to_pylist(), *(batch[c] for c in ("x", "y", "p", "q")), strict=True):
                shared = int(np.bitwise_count(np.frombuffer(p.as_py(), dtype=np.uint8) & np.frombuffer(q.as_py(), dtype=np.uint8)).sum())
                both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
                both.sort(kind="stable")
                shared += int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (n + m - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    side = lambda i, *to: met.select(F.col("id").alias(i), F.col("n").alias(to[0]), F.col("others").alias(to[1]), F.col("mask").alias(to[2]))
    full = pairs.join(side("b", "m", "y", "q"), "b").join(side("a", "n", "x", "p"), "a")
    return full.select("a", "b", "n", "m", "x", "y", "p", "q").mapInArrow(run, "a long, b long")


def _open_pairs(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of one group and different components that the bounds leave; one of the two is outside the group's largest component."""
    need = lambda m, n: F.ceil(F.lit(percent) * (m + n) / F.lit(100 + percent))
    largest = met.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("grp").agg(F.max(F.struct("k", "comp"))["comp"].alias("big"), F.lit(1).alias("one"))
    least = met.groupBy("grp").agg(F.min("n").alias("least"))
    known = met.drop("mask").join(largest.drop("one"), "grp").join(least, "grp").withColumn("outside", F.col("comp") != F.col("big"))
    # the smallest partner that a node can link with at all
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    known = known.withColumn("t", F.greatest(F.lit(1), need(F.col("n"), partner) - F.col("inter")))

    # pairs that share some of the other shingles: both have one of those among their rarest, and enough of them after it
    rows = known.select("grp", "id", "comp", "n", "inter", "outside", "t", F.size("others").alias("m"), F.explode("others").alias("shingle"))
    often = rows.groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("f"), F.bool_or("outside").alias("asked")).where("f > 1 and asked").drop("asked")
    ranked = rows.join(often, ["grp", "shingle"], "left").withColumn("r", F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.coalesce("f", F.lit(1)), "shingle")))
    prefix = ranked.where("r <= m - t + 1 and f > 1")
    side = lambda d, c: d.select("grp", "shingle", *[F.col(k).alias(c + v) for k, v in (("id", "i"), ("comp", "c"), ("n", "n"), ("inter", "k"), ("m", "m"), ("r", "r"))])
    x, y = side(prefix.where("outside"), "x"), side(prefix, "y")
    ratio = 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
    enough = 1 + F.least(F.col("xm") - F.col("xr"), F.col("ym") - F.col("yr")) >= need(F.col("xn"), F.col("yn")) - F.least("xk", "yk")
    shared = x.join(y, ["grp", "shingle"]).where((F.col("xc") != F.col("yc")) & ratio & enough)

    # pairs that need none: by sizes, of which a group has few
    near = known.where(need(F.col("n"), partner) <= F.col("inter")).select("grp", "id", "comp", "n", "inter", "outside")
    reach = F.floor(F.col("inter") * F.lit(100 + percent) / percent) - F.col("n")
    sizes = near.select("grp", F.col("n").alias("yn")).distinct()
    asks = near.where("outside").withColumn("reach", reach).join(sizes, "grp").where((F.col("yn") <= F.col("reach")) & (100 * F.least("n", "yn") >= percent * F.greatest("n", "yn")))
    asks = asks.select("grp", "yn", F.col("id").alias("xi"), F.col("comp").alias("xc"), F.col("n").alias("xn"), F.col("inter").alias("xk"))
    others = near.select("grp", F.col("n").alias("yn"), F.col("id").alias("yi"), F.col("comp").alias("yc"), F.col("inter").alias("yk"))
    plain = asks.join(others, ["grp", "yn"]).where((F.col("xc") != F.col("yc")) & (F.least("xk", "yk") >= need(F.col("xn"), F.col("yn"))))
    pairs = shared.select("xi", "yi").unionAll(plain.select("xi", "yi"))
    return pairs.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable over links) and kept, for each row of docs."""
    lean(docs.sparkSession)
    rows = cut(signed(docs, k, key, text))
    nodes = rows.where("n_shingles > 0").groupBy("_set").agg(F.min("_id").alias("_id"), F.first("_bands").alias("bands"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("id"), "_id", "_set", "bands"))

    members = nodes.select(F.explode("bands").alias("bucket"), "id")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    live = cut(members.join(shared, "bucket"))
    popular = live.groupBy("id").agg(F.sum("c").alias("p"))
    ranked = live.join(popular, "id")
    pivots = ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("p"), F.col("id"))).alias("m")).select("bucket", F.col("m.id").alias("b"))
    pairs = live.join(pivots, "bucket").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    texts = docs.select(F.col(key).alias("_id"), text_bytes(docs, text).alias("_t"))
    sets = cut(_sets(texts, nodes.select("id", "_id", "_set").join(popular, "id"), k))
    links = cut(_confirmed(pairs, sets, percent))
    found = components(links)
    label = cut(popular.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp")))
    placed = live.join(label, "id")
    open_ = cut(_split(placed).join(pivots, "bucket").select("id", "comp", F.col("b").alias("pivot")).distinct())
    if not open_.isEmpty():
        groups = components(open_.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        member = open_.select("id", "comp").distinct().join(groups.select("id", F.col("component").alias("grp")), "id")
        refs = member.join(popular, "id").groupBy("grp").agg(F.min(F.struct(-F.col("p"), F.col("id")))["id"].alias("ref"))
        met = cut(_against_reference(member.join(refs, "grp"), sets))
        found = components(links.unionByName(cut(_confirmed_in_group(_open_pairs(met, percent), met, percent))))

    placed = cut(nodes.select("id", "_id", "_set").join(found, "id", "left").select("_id", "_set", F.coalesce("component", "id").alias("component")))
    least = placed.groupBy("component").agg(F.min("_id").alias("component_id"))
    class_of = placed.join(least, "component").select("_set", "component_id", F.lit(True).alias("_in"))
    out = rows.join(class_of, "_set", "left").select(F.col("_id").alias(key), "n_shingles", F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates; rows with a null id stay, rows that share an id go only if all of them do."""
    of_id = near_duplicates(docs, k, percent, key, text).where(F.col(key).isNotNull()).groupBy(key).agg(F.max("kept").alias("kept"))
    return docs.join(of_id.where(~F.col("kept")).select(key), key, "left_anti").select(docs.columns)
