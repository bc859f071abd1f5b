"""Language-model scoring by context-tree weighting over bytes, beside a unigram word model.

Each byte is eight binary decisions; each decision has a tree of contexts, the preceding DEPTH bytes,
latest first. A context holds how often either bit followed it in the training texts; its
Krichevsky-Trofimov estimate is mixed with that of the longer contexts below it by the weight that the
training data gives (one half a priori), so all depths speak. A context that training never met has the
empty estimate, one half, and is mixed like any other. Scoring reads the tree as training left it: weights and
counts don't move with the text scored. A text's score is the base-10 logarithm of its probability, bytes
and end included.

Blocks of documents count strings of DEPTH + 1 bytes and words, and send them packed; totals are
summed by buckets, one tree is weighted for each two preceding bytes, and the levels above, of 256 contexts at most,
come together on the driver. Blocks get back a logarithm (32 bits, so to seven digits) for each of their strings and a
count for each of their words. Words are told apart by 63-bit hashes.

Null texts count as empty and have the end only. With no training text every bit has one half. Rows that
repeat, or share an id, are documents of their own. Very long texts are read whole. Only the id, the text and the training
mark are read: other columns are not in the result. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _blocks as B
from tessera.llm._text import LOWER, mix, to_bytes, unvarint, varints, word_bounds, word_hashes

#: Context bytes, and those of them that a tree is dealt by.
DEPTH, DEALT = 5, 2
#: Bytes of a block, and bytes of all texts for each bucket of words and of strings.
BLOCK_BYTES, WORDS_PER_BUCKET, GRAMS_PER_BUCKET, DENSE = 4 << 20, 8 << 20, 32 << 20, 1 << 19
LINE = np.array([10], dtype=np.uint8)
#: For each bit of a byte the lower ones.
BELOW = ((1 << np.arange(8)) - 1).astype(np.uint8)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up to arguments over 8."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = np.where(small, shift - np.log(np.where(small, x, 1)), shift)
        x = np.where(small, x + 1, x)
    inv = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260


def gram_ids(x: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each place a number of the depth + 1 bytes from it, and the bytes of each number (first byte highest); numbers rise with them."""
    n = len(x) - depth
    ids, value = np.zeros(n, dtype=np.uint32), np.zeros(1, dtype=np.uint64)
    first = min(3, depth + 1)  # so many bytes at once, as all their numbers fit one table
    for k in range(first - 1, depth + 1):
        if k == first - 1:
            key = np.zeros(n, dtype=np.uint32)
            for j in range(first):
                key <<= np.uint32(8)
                key |= x[j : n + j]
            value = np.arange(256 ** (first - 1), dtype=np.uint64)
        else:
            key = ids.astype(np.uint32 if len(value) < 1 << 24 else np.uint64)
            key *= key.dtype.type(256)
            key += x[k : n + k]
        if len(value) <= DENSE:
            there = np.zeros(len(value) * 256, dtype=bool)
            there[key] = True
            distinct = np.flatnonzero(there)
            # the number of a key: those before its byte of the bitmap, and those below it there
            bits = np.packbits(there, bitorder="little")
            del there
            many = np.bitwise_count(bits)
            before = np.cumsum(many, dtype=np.uint32) - many
            ids = np.empty(n, dtype=np.uint32)
            for a in range(0, n, 1 << 18):
                some = key[a : a + (1 << 18)]
                at = some >> some.dtype.type(3)
                ids[a : a + (1 << 18)] = before[at] + np.bitwise_count(bits[at] & BELOW[some & some.dtype.type(7)])
            del bits, many, before
        else:
            distinct, ids = np.unique(key, return_inverse=True)
            ids = ids.astype(np.uint32)
        del key
        value = value[distinct // 256] * np.uint64(256) + (distinct % 256).astype(np.uint64)
    return ids, value


class BlockText:
    """A block's documents laid end to end: strings of DEPTH + 1 bytes and words."""

    def __init__(self, t: pa.Table):
        docs = [to_bytes(x.as_py()) for x in t["_t"]]
        self.train = np.array([bool(x) for x in t["_train"].to_pylist()], dtype=bool)
        self.sizes = np.array([len(b) for b in docs], dtype=np.int64)
        pad, end = np.zeros(DEPTH, dtype=np.uint8), np.zeros(1, dtype=np.uint8)
        flat = np.concatenate([y for b in docs for y in (pad, b, end)] + [np.zeros(DEPTH, dtype=np.uint8)])
        ids, self.grams = gram_ids(flat)
        begins = np.cumsum(np.concatenate([[0], self.sizes + DEPTH + 1]))[:-1]
        edge = np.zeros(len(ids) + 1, dtype=np.int8)
        edge[begins] += 1
        edge[begins + self.sizes + 1] -= 1
        self.ids = ids[np.cumsum(edge[:-1], dtype=np.int8) > 0]
        del flat, ids, edge
        self.doc_of_byte = np.repeat(np.arange(len(docs), dtype=np.int32), self.sizes + 1)
        # a line end between two documents ends a word and begins none
        begins = np.cumsum(np.concatenate([[0], self.sizes + 1]))
        lines = LOWER[np.concatenate([np.zeros(0, dtype=np.uint8), *(y for b in docs for y in (b, LINE))])]
        starts, ends = word_bounds(lines)
        words = word_hashes(lines, starts, ends) >> np.uint64(1)
        self.doc_of_word = np.searchsorted(begins, starts, side="right") - 1
        self.n_words = np.bincount(self.doc_of_word, minlength=len(docs)).astype(np.int64)
        self.words, self.word_ids = np.unique(words, return_inverse=True)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(varints(values)[0])


def unpack(raw: pa.Scalar) -> np.ndarray:
    return unvarint(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), dtype=np.uint8))[0]


def pack_rising(keys: np.ndarray) -> bytes:
    """Rising numbers under 2**63, by their differences."""
    return pack(np.diff(keys.astype(np.int64), prepend=0))


def unpack_rising(raw: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpack(raw)).astype(np.uint64)


SENT = "_block long, kind string, _bucket long, keys binary, many binary, extra binary"


def _send(block: int, t: pa.Table, word_buckets: int, gram_buckets: int):
    x = BlockText(t)
    row = {"_block": block, "extra": None}
    yield row | {"kind": "tokens", "_bucket": int((x.n_words + 1)[x.train].sum()), "keys": None, "many": None}
    many = np.bincount(x.word_ids[x.train[x.doc_of_word]], minlength=len(x.words))
    for kind, keys, n, buckets in (("words", x.words, many, word_buckets), ("grams", x.grams, np.bincount(x.ids[x.train[x.doc_of_byte]], minlength=len(x.grams)), gram_buckets)):
        for b, at in _dealt(keys, buckets):
            yield row | {"kind": kind, "_bucket": b, "keys": pack_rising(keys[at]), "many": pack(n[at])}


def _dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in their order."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
    return [(b, order[a:z]) for b, a, z in B.runs(bucket[order])]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def _keys(t: pa.Table) -> list[np.ndarray]:
    return [unpack_rising(x) for x in t["keys"]]


def _sum(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all rows, their totals, and each row's keys."""
    keys = _keys(t)
    many = np.concatenate([unpack(x) for x in t["many"]])
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, weights=many, minlength=len(u)).astype(np.int64), keys


def weight_of(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts: the weight of their own estimate, their estimate of a one, and the logarithm of what they say together with those below."""
    own = log_kt(n0, n1)
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), (n1 + 0.5) / (n0 + n1 + 1), np.logaddexp(own, below) - np.log(2)


class Tree:
    """The weighted trees of all contexts whose latest ``dealt`` bytes are the same, for each binary decision.

    grams: strings of ``depth`` context bytes (oldest first) and the next byte; total: how often each was in training.
    """

    def __init__(self, grams: np.ndarray, total: np.ndarray, depth: int = DEPTH, dealt: int = DEALT):
        self.grams, self.levels = grams, range(dealt, depth + 1)
        nxt = (grams & np.uint64(255)).astype(np.int64)
        context = grams >> np.uint64(8)
        #: for each string the latest byte of its context, and for each decision its node 1..255 by the bits before, and its bit
        self.last = (context & np.uint64(255)).astype(np.int64)
        self.node = np.stack([(1 << i) | (nxt >> (8 - i)) for i in range(8)])
        self.bit = np.stack([(nxt >> (7 - i)) & 1 for i in range(8)])
        self.at, self.own, self.weight, counts, keys = [], [], [], [], []
        for d in self.levels:
            key = ((context & np.uint64((1 << (8 * d)) - 1))[None, :] << np.uint64(8)) | self.node.astype(np.uint64)
            u, inv = np.unique(key.ravel(), return_inverse=True)
            inv = inv.reshape(key.shape)
            n = np.bincount(inv.ravel(), weights=np.broadcast_to(total, key.shape).ravel(), minlength=len(u))
            n1 = np.bincount(inv.ravel(), weights=(self.bit * total[None, :]).ravel(), minlength=len(u))
            keys.append(u)
            counts.append((n - n1, n1))
            self.at.append(inv)
        below = None
        for i in range(len(self.levels) - 1, -1, -1):
            n0, n1 = counts[i]
            if below is None:
                weight, own, said = np.ones(len(n0)), (n1 + 0.5) / (n0 + n1 + 1), log_kt(n0, n1)
            else:
                parent = np.zeros(len(keys[i + 1]), dtype=np.int64)
                parent[self.at[i + 1].ravel()] = self.at[i].ravel()
                weight, own, said = weight_of(n0, n1, np.bincount(parent, weights=below, minlength=len(n0)))
            self.weight.insert(0, weight)
            self.own.insert(0, own)
            below = said
        #: for the level above: latest byte, node, zeros, ones and the logarithm of what the contexts say
        self.top = [((keys[0] >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (keys[0] & np.uint64(255)).astype(np.int64), *counts[0], below]

    def log10(self, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Base-10 logarithm of each string's last byte after the others. above: weights and estimates by decision of no byte, and by latest byte and decision of one."""
        out = np.zeros(len(self.grams))
        for i in range(8):
            p = self.own[-1][self.at[-1][i]]
            for at, own, weight in zip(self.at[-2::-1], self.own[-2::-1], self.weight[-2::-1], strict=True):
                w = weight[at[i]]
                p = w * own[at[i]] + (1 - w) * p
            for weight, own in reversed(above):
                at = (self.last, self.node[i]) if weight.ndim == 2 else self.node[i]
                p = weight[at] * own[at] + (1 - weight[at]) * p
            out += np.log10(np.where(self.bit[i] == 1, p, 1 - p))
        return out


def upper_levels(last: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and estimates of the empty context and of contexts of one byte, from sums over those of two."""
    table = np.zeros((3, 256, 256))
    for t, v in zip(table, (n0, n1, below), strict=True):
        np.add.at(t, (last, node), v)
    one = weight_of(*table)
    seen = table[0] + table[1] > 0
    root = weight_of(table[0].sum(0), table[1].sum(0), np.where(seen, one[2], 0).sum(0))
    return [root[:2], one[:2]]


def score(docs: DataFrame, train: Column, spark: SparkSession, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_bytes, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (code length), for each row of docs."""
    docs = docs.select(key, text, F.coalesce(train, F.lit(False)).alias("_train"))
    left, n, total = B.blocked(docs, key, text, block_bytes)
    left = left.select(key, "_train", "_t", "_block")
    word_buckets, gram_buckets = max(1, total // WORDS_PER_BUCKET), max(1, total // GRAMS_PER_BUCKET)
    sent = B.cut(B.per_block(left, lambda b, t: _send(b, t, word_buckets, gram_buckets), SENT))
    tokens = sent.where("kind = 'tokens'").agg(F.sum("_bucket")).first()[0] or 0
    back = min(n, B.MOST_PARTS)

    def count_words(k: tuple, t: pa.Table) -> pa.Table:
        B.trim()
        u, sums, keys = _sum(t)
        answers = [pack(sums[np.searchsorted(u, x)]) for x in keys]
        n, bucket = len(answers), k[0].as_py()
        # the last row has the number of distinct training words in place of a bucket
        return pa.table({"_block": pa.array([*t["_block"].to_pylist(), -1]), "kind": pa.array(["words"] * (n + 1)), "_bucket": pa.array([bucket] * n + [int((sums > 0).sum())]), "values": pa.array([*answers, None], pa.binary())})

    answered = "_block long, kind string, _bucket long, values binary"
    counted = B.cut(sent.where("kind = 'words'").repartition(min(word_buckets, B.MOST_PARTS), "_bucket").groupBy("_bucket").applyInArrow(count_words, answered))
    distinct = (counted.where("_block = -1").agg(F.sum("_bucket")).first()[0] or 0) + (1 if tokens else 0)

    def by_context(k: tuple, t: pa.Table) -> pa.Table:
        B.trim()
        u, sums, _ = _sum(t)
        context = ((u >> np.uint64(8)) & np.uint64((1 << 8 * DEALT) - 1)).astype(np.int64)
        order = np.argsort(context, kind="stable")
        groups = B.runs(context[order])
        return pa.table({"context": pa.array([g for g, _, _ in groups], pa.int64()), "keys": pa.array([pack_rising(u[order[a:z]]) for _, a, z in groups], pa.binary()), "many": pa.array([pack(sums[order[a:z]]) for _, a, z in groups], pa.binary())})

    grams = sent.where("kind = 'grams'").repartition(min(gram_buckets, B.MOST_PARTS), "_bucket")
    totals = B.cut(grams.groupBy("_bucket").applyInArrow(by_context, "context long, keys binary, many binary"))

    def tree_of(t: pa.Table) -> Tree:
        g = np.concatenate([unpack_rising(x) for x in t["keys"]])
        c = np.concatenate([unpack(x) for x in t["many"]])
        order = np.argsort(g)
        return Tree(g[order], c[order].astype(np.float64))

    def top(k: tuple, t: pa.Table) -> pa.Table:
        return pa.table(tree_of(t).top, names=["last", "node", "n0", "n1", "below"])

    tops = totals.groupBy("context").applyInArrow(top, "last long, node long, n0 double, n1 double, below double").groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toPandas()  # 65,280 rows at most
    above = upper_levels(*(tops[c].to_numpy() for c in ("last", "node", "n0", "n1", "below")))

    def logs(k: tuple, t: pa.Table) -> pa.Table:
        B.trim()
        tree = tree_of(t)
        values, dealt = tree.log10(above).astype(np.float32), _dealt(tree.grams, gram_buckets)
        return pa.table({"_bucket": pa.array([b for b, _ in dealt], pa.int64()), "keys": pa.array([pack_rising(tree.grams[at]) for _, at in dealt], pa.binary()), "logs": pa.array([values[at].tobytes() for _, at in dealt], pa.binary())})

    def answer(k: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        B.trim()
        u = np.concatenate([unpack_rising(x) for x in known["keys"]])
        v = np.concatenate([np.frombuffer(x.as_py(), dtype=np.float32) for x in known["logs"]])
        order = np.argsort(u)
        u, v = u[order], v[order]
        values = [v[np.searchsorted(u, x)].tobytes() for x in _keys(asked)]
        return pa.table({"_block": asked["_block"], "kind": pa.array(["grams"] * len(values)), "_bucket": asked["_bucket"], "values": pa.array(values, pa.binary())})

    weighted = totals.groupBy("context").applyInArrow(logs, "_bucket long, keys binary, logs binary").repartition(min(gram_buckets, B.MOST_PARTS), "_bucket")
    replies = grams.groupBy("_bucket").cogroup(weighted.groupBy("_bucket")).applyInArrow(answer, answered)
    replies = replies.unionByName(counted.where("_block >= 0")).repartition(back, "_block")

    def finish(block: int, t: pa.Table, right: pa.Table) -> pa.Table:
        x = BlockText(t)
        gram_log, word_count = np.zeros(len(x.grams)), np.zeros(len(x.words), dtype=np.int64)
        gram_at, word_at = dict(_dealt(x.grams, gram_buckets)), dict(_dealt(x.words, word_buckets))
        for kind, b, v in zip(right["kind"].to_pylist(), right["_bucket"].to_pylist(), right["values"], strict=True):
            if kind == "grams":
                gram_log[gram_at[b]] = np.frombuffer(v.as_py(), dtype=np.float32)
            else:
                word_count[word_at[b]] = unpack(v)
        docs = len(x.sizes)
        bottom = np.log10(tokens + distinct + 1)
        c = word_count[x.word_ids]
        base = np.bincount(x.doc_of_word, weights=np.log10(c + 1.0), minlength=docs) + np.log10(ends + 1.0) - (x.n_words + 1) * bottom
        total_log = np.bincount(x.doc_of_byte, weights=gram_log[x.ids], minlength=docs)
        known = np.bincount(x.doc_of_word, weights=c > 0, minlength=docs).astype(np.int64) + (ends > 0)
        return pa.table({key: t[key], "n_bytes": pa.array(x.sizes), "n_tokens": pa.array(x.n_words + 1), "n_known": pa.array(known), "train_tokens": pa.array([tokens] * docs, pa.int64()), "base_score": pa.array(base), "score": pa.array(total_log), "bits_per_byte": pa.array(-total_log / np.log10(2) / (x.sizes + 1))})

    ends = docs.where("_train").count()
    kind = left.schema[key].dataType.simpleString()
    return B.per_block_with(left, replies, finish, f"`{key}` {kind}, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
