"""Suffix-array dedup: byte strings of a fixed length that occur twice are removed.

Induced sorting, vectorised: suffixes are classified as S or L, the leftmost S of each run (LMS) cut
the text into substrings, inducing from the LMS suffixes' first symbols ranks those substrings, equal
ones sharing a rank; if ranks are shared, the string of ranks is sorted recursively; inducing from the
sorted LMS suffixes then ranks every suffix, in one pass over the buckets for L and one for S. Common
prefixes of neighbours in the suffix array are computed in text order (permuted): only irreducible
ones are compared, the others are one less than the one before.

To sort shards apart, each window of ``length`` bytes belongs to its minimiser, the smallest hash of
its strings of a quarter of that (48 bytes at most), so equal windows share a minimiser. Neighbouring windows of one document with
one minimiser form a segment. Minimisers that only one segment has cannot repeat and are left out
(counted as packed hashes); the other segments go to the shard of their minimiser, equal segments of
a block once with their number, and each shard's suffix arrays are built over its distinct segments,
``PART`` bytes at a time: segments of one minimiser stay together, and where these alone are more, they are cut by
longer minimisers, on which equal windows agree as well. The segments of a minimiser with over ``HOT`` of them are
cut so by the block already and dealt to the shards of the longer ones, so that no shard has to hold all contexts of a common phrase.

The length is 16 at least. Matches never cross documents; strings are judged on the input; overlaps count. Null texts count as
empty; texts shorter than the length keep all. A row that repeats is another document, null ids are like others. Other columns
pass through, whatever they are called; columns named like the outputs are replaced. Very long texts are cut into
segments like others. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _blocks as B
from tessera.llm._text import mix, to_bytes
from tessera.llm.substring import covered, intervals

LENGTH, SHORTEST, HOT, LONGEST = 200, 16, 16_384, 4096
BLOCK_BYTES, BUCKET_BYTES, PART = 4 << 20, 64 << 20, 1 << 20


# --- one shard's suffix array ------------------------------------------------------------------


def _levels(low: np.ndarray, high: np.ndarray, symbols: int) -> np.ndarray:
    """For each symbol, how many buckets must be finished one after another before its own (edges low -> high)."""
    level = np.zeros(symbols, dtype=np.int64)
    if len(low):
        edge = np.unique(low * np.int64(symbols) + high)
        low, high = edge // symbols, edge % symbols
        while True:
            new = level.copy()
            np.maximum.at(new, high, level[low] + 1)
            if np.array_equal(new, level):
                break
            level = new
    return level


def _induce(t: np.ndarray, nxt: np.ndarray, run: np.ndarray, is_s: np.ndarray, lms: np.ndarray, seed: np.ndarray, symbols: int) -> np.ndarray:
    """Ranks of all suffixes (equal only where the seeds leave them equal) from ranks of the LMS suffixes among themselves.

    nxt: the next place with another symbol; run: how many equal symbols stand before it. A rank is a place
    in the suffix array: in the bucket of a symbol come its L suffixes, then its S suffixes.
    """
    n = len(t)
    count = np.bincount(t, minlength=symbols)
    end = np.cumsum(count)
    start = end - count
    rank = np.zeros(n, dtype=np.int32)
    # LMS suffixes stand at the end of their bucket, in the order of their seeds
    order = np.argsort(t[lms] * np.int64(n + 1) + seed)
    sym = t[lms][order]
    per = np.bincount(sym, minlength=symbols)
    offset = np.arange(len(order)) - (np.cumsum(per) - per)[sym]
    tie = np.concatenate([[True], (sym[1:] != sym[:-1]) | (seed[order][1:] != seed[order][:-1])]) if len(order) else np.zeros(0, dtype=bool)
    offset = offset[np.maximum.accumulate(np.where(tie, np.arange(len(order)), 0))] if len(order) else offset
    rank[lms[order]] = end[sym] - per[sym] + offset
    runs, span = int(run.max(initial=1)) + 1, n + 2
    narrow = symbols * runs < 2**62 // span  # symbol, run and rank fit one number

    def fill(members: np.ndarray, up: bool) -> None:
        own, after = t[members], nxt[members]
        depends = ~is_s[after] if up else is_s[after]
        level = _levels(t[after[depends]], own[depends], symbols)[own]
        by_level = np.argsort(level.astype(np.int16) if level.max(initial=0) < 2**15 else level, kind="stable")
        members, own, after, level = members[by_level], own[by_level], after[by_level], level[by_level]
        bounds = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]])) if len(level) else []
        inner = run[members] if up else runs - run[members]
        head = (own * np.int64(runs) + inner) * np.int64(span) if narrow else None
        base = start if up else end - np.bincount(own, minlength=symbols)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if narrow:
                key = head[a:z] + rank[after[a:z]]
                by = np.argsort(key)
                key, s = key[by], own[a:z][by]
                new = key[1:] != key[:-1]
            else:
                parts = [rank[after[a:z]], inner[a:z], own[a:z]]
                by = np.lexsort(parts)
                s = own[a:z][by]
                new = np.any([x[by][1:] != x[by][:-1] for x in parts], axis=0)
            i = np.arange(z - a, dtype=np.int32)
            if not new.all():
                i[1:][~new] = 0
                i = np.maximum.accumulate(i)
            bucket = np.flatnonzero(s[1:] != s[:-1]) + 1
            if len(bucket):
                i -= np.repeat(np.concatenate([[0], bucket]), np.diff(np.concatenate([[0], bucket, [z - a]])))
            rank[members[a:z][by]] = base[s] + i

    fill(np.flatnonzero(~is_s[: n - 1]), True) if n > 1 else None
    if not is_s[n - 1]:
        raise ValueError("the text must end with its smallest symbol")
    last = rank[n - 1]
    fill(np.flatnonzero(is_s[: n - 1]), False) if n > 1 else None
    rank[n - 1] = min(last, start[t[n - 1]])
    return rank


def suffix_ranks(t: np.ndarray, symbols: int) -> np.ndarray:
    """The rank of each suffix of t, whose last symbol is 0 and stands nowhere else."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    t = t.astype(np.int32, copy=False)
    differs = t[1:] != t[:-1]
    change = np.flatnonzero(differs).astype(np.int32) + 1
    group = np.zeros(n, dtype=np.int32)
    np.cumsum(differs, out=group[1:])
    nxt = np.append(change, np.int32(n - 1))[group]
    run = nxt - np.arange(n, dtype=np.int32)
    is_s = t < t[nxt]
    is_s[n - 1] = True
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    name = _induce(t, nxt, run, is_s, lms, np.zeros(len(lms), dtype=np.int64), symbols)[lms]
    u, dense = np.unique(name, return_inverse=True)
    order = dense if len(u) == len(lms) else suffix_ranks(dense, len(u))
    return _induce(t, nxt, run, is_s, lms, order, symbols)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the length (up to most) of the prefix that its suffix shares with the one before it in the suffix array."""
    n = len(t)
    before = np.empty(n, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    reducible = np.zeros(n, dtype=bool)
    reducible[1:] = (before[1:] > 0) & (t[:-1] == t[before[1:] - 1])
    at = np.flatnonzero(~reducible & (before >= 0)).astype(np.int32)
    value = np.zeros(n, dtype=np.int32)
    # past the end stand symbols found nowhere else, one kind for either side
    left, right = np.concatenate([t, np.full(9, -1, dtype=t.dtype)]), np.concatenate([t, np.full(9, -2, dtype=t.dtype)])
    a, b, length = at, before[at], 0
    while len(at):
        same = left[a] == right[b]
        value[at[~same]] = length
        at, a, b = at[same], a[same] + 1, b[same] + 1
        length += 1
    i = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.minimum(np.where(reducible, np.maximum(value[head] - (i - head), 0), value), most)


def repeated(segments: list[np.ndarray], owned: np.ndarray, many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its first ``owned`` windows of length bytes occur twice among those of all segments, many of each."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n = int((sizes + 1).sum())
    # segment i ends with symbol m - 1 - i, smaller than every byte and found nowhere else
    m = len(segments)
    stops = begin + sizes
    t = np.frombuffer(b"".join(x.tobytes() + b"\0" for x in segments), dtype=np.uint8).astype(np.int32) + np.int32(m)
    t[stops] = np.arange(m)[::-1]
    rank = suffix_ranks(t, m + 256)
    sa = np.empty(n, dtype=np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    shared = permuted_lcp(t, sa, length)
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[begin] += many
    np.add.at(edge, begin + owned, -many)
    weight = np.cumsum(edge[:-1])
    group = np.cumsum(shared[sa] < length) - (1 if shared[sa[0]] < length else 0)
    total = np.bincount(group, weights=weight[sa])
    twice = np.empty(n, dtype=bool)
    twice[sa] = total[group] >= 2
    return [twice[b : b + o] for b, o in zip(begin.tolist(), owned.tolist(), strict=True)]


def repeated_in_parts(pieces: list[np.ndarray], many: np.ndarray, keys: np.ndarray, length: int, level: int = 0) -> list[np.ndarray]:
    """``repeated`` for all windows of pieces, some PART bytes at a time; only pieces of one key can share windows."""
    sizes, longer = np.array([len(x) for x in pieces], dtype=np.int64), longer_grams(length)
    order = np.argsort(keys, kind="stable")
    groups = np.split(order, np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1)
    found: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pieces)

    def finish(part: list[int]) -> None:
        some = np.array(part, dtype=np.int64)
        for i, x in zip(part, repeated([pieces[i] for i in part], sizes[some] - length + 1, many[some], length), strict=True):
            found[i] = x

    part, held = [], 0
    for group in groups:
        size = int(sizes[group].sum())
        if size > PART and level < len(longer):
            number: dict[bytes, int] = {}
            times, of, places = [], [], []
            for i in group.tolist():
                found[i] = np.zeros(sizes[i] - length + 1, dtype=bool)
                for key, _, a, n in cut_runs(pieces[i], length, longer[level]):
                    k = number.setdefault(pieces[i][a : a + n + length - 1].tobytes(), len(number))
                    if k == len(times):
                        times.append(0)
                        of.append(key)
                    times[k] += int(many[i])
                    places.append((k, i, a, n))
            answer = repeated_in_parts([np.frombuffer(x, dtype=np.uint8) for x in number], np.array(times, dtype=np.int64), np.array(of, dtype=np.uint64), length, level + 1)
            for k, i, a, n in places:
                found[i][a : a + n] = answer[k]
            continue
        if part and held + size > PART:
            finish(part)
            part, held = [], 0
        part += group.tolist()
        held += size
    if part:
        finish(part)
    return found


# --- windows, minimisers and segments of a block -----------------------------------------------


def gram_size(length: int) -> int:
    """Bytes of the strings that minimisers are taken from: a quarter of the window, a multiple of 8, 48 at most.

    Long ones seldom repeat by chance; short ones make longer segments.
    """
    return max(8, min(48, length // 32 * 8))


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a multiple of 8) from each place."""
    x = np.ndarray((len(b) - 7,), dtype="<u8", buffer=b, strides=(1,)).copy()
    n = len(b) - size + 1
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at in range(8, size, 8):
        h += x[at : at + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(h)
    pad = -n % w
    x = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def longer_grams(length: int) -> tuple[int, int]:
    """Bytes of the longer strings by which the windows of one minimiser are cut: three quarters of the window, and all but the last 8 of it."""
    return max(8, 3 * length // 32 * 8), max(8, length // 8 * 8 - 8)


def cut_runs(b: np.ndarray, length: int, size: int) -> list[tuple[int, bool, int, int]]:
    """(minimiser, may it repeat by itself, first window, windows) of the runs of windows of b with one minimiser among strings of ``size`` bytes."""
    grams = gram_hashes(b, size)
    low = sliding_min(grams, length - size + 1)
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    key, grams = low[at], np.sort(grams)
    again = np.searchsorted(grams, key, side="right") - np.searchsorted(grams, key) > 1
    return list(zip(key.tolist(), again.tolist(), at.tolist(), np.diff(np.append(at, len(low))).tolist(), strict=True))


class Segments:
    """The segments of a block: minimiser, document, first window and number of windows."""

    def __init__(self, texts: pa.ChunkedArray, length: int):
        self.length, self.docs = length, [to_bytes(x.as_py()) for x in texts]
        keys, doc, first, own, again = [], [], [], [], []
        for d, b in enumerate(self.docs):
            if len(b) < length:
                continue
            size = gram_size(length)
            grams = gram_hashes(b, size)
            low = sliding_min(grams, length - size + 1)
            at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            own_ = np.diff(np.append(at, len(low)))
            if own_.max() > LONGEST:  # a long run of one minimiser: cut it
                parts = -(-own_ // LONGEST)
                inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                at = np.repeat(at, parts) + inner * LONGEST
                own_ = np.diff(np.append(at, len(low)))
            keys.append(low[at])
            # a string that has its minimiser twice in one document may repeat within a segment
            small = np.sort(grams[grams <= keys[-1].max()])
            again.append(np.searchsorted(small, keys[-1], side="right") - np.searchsorted(small, keys[-1]) > 1)
            doc.append(np.full(len(at), d))
            first.append(at)
            own.append(own_)
        cat = lambda x, kind: np.concatenate([*x, np.zeros(0, dtype=kind)]).astype(kind)
        self.key, self.doc, self.first, self.own, again = cat(keys, np.uint64), cat(doc, np.int64), cat(first, np.int64), cat(own, np.int64), cat(again, bool)
        #: how often each segment counts: two for those that may repeat by themselves
        self.times = 1 + again.astype(np.int64)

    def content(self, i: int) -> bytes:
        a = self.first[i]
        return self.docs[self.doc[i]][a : a + self.own[i] + self.length - 1].tobytes()

    def shards(self, code: np.ndarray, shards: int) -> dict[int, dict[bytes, list]]:
        """For each shard its distinct pieces in a fixed order: minimiser, whether it may repeat by itself, and then (document, first window) of each occurrence.

        code: of each segment 0 (cannot repeat), 1, or 2 (cut by longer minimisers).
        """
        out: dict[int, dict[bytes, list]] = {}
        size = longer_grams(self.length)[0]
        for i in np.flatnonzero(code).tolist():
            key, d, a = int(self.key[i]), int(self.doc[i]), int(self.first[i])
            raw = self.content(i)
            if code[i] == 1:
                out.setdefault(key % shards, {}).setdefault(raw, [key, self.times[i] > 1]).append((d, a))
                continue
            for sub, again, j, n in cut_runs(np.frombuffer(raw, dtype=np.uint8), self.length, size):
                both = (sub * 0x9E3779B97F4A7C15 + key) % 2**64
                both ^= both >> 32
                out.setdefault(both % shards, {}).setdefault(raw[j : j + n + self.length - 1], [both, again]).append((d, a + j))
        return {s: dict(sorted(x.items())) for s, x in sorted(out.items())}


def _level(total: np.ndarray) -> np.ndarray:
    """0: found once; 1: more often; 2: so often that its segments are cut by longer minimisers."""
    return (total >= 2).astype(np.uint8) + (total > HOT).astype(np.uint8)


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", whole_characters: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long), removed (array of byte intervals [first, last)) and kept (binary: the bytes left).

    whole_characters: intervals shrink to whole UTF-8 characters, so that kept is text.
    """
    if length < SHORTEST:
        raise ValueError(f"length must be {SHORTEST} or more")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "removed", "kept")
    docs, renamed = B.shielded(docs, "_t", "_block")
    left, n, total = B.blocked(docs, key, text, block_bytes)
    buckets = max(1, total // BUCKET_BYTES)
    shards, back = 2 * n, min(n, B.MOST_PARTS)

    def send(block: int, t: pa.Table):
        s = Segments(t["_t"], length)
        u, back_ = np.unique(s.key, return_inverse=True)
        c = np.bincount(back_, weights=s.times, minlength=len(u))
        bucket = ((u >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            yield {"_block": block, "_bucket": b, "keys": B.pack(u[bucket == b]), "many": B.pack(c[bucket == b].astype(np.uint32)), "extra": None}

    counted = B.count_packed(B.per_block(left, send, B.COUNTED), "<u8", min(buckets, B.MOST_PARTS), _level).drop("extra")

    def code_of(s: Segments, right: pa.Table) -> np.ndarray:
        u, inverse = np.unique(s.key, return_inverse=True)
        bucket = ((u >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        code = np.zeros(len(u), dtype=np.uint8)
        for b, x in zip(right["_bucket"], right["codes"], strict=True):
            code[bucket == b.as_py()] = np.frombuffer(x.as_py(), dtype=np.uint8)
        return code[inverse]

    def ship(block: int, t: pa.Table, right: pa.Table):
        s = Segments(t["_t"], length)
        for shard, pieces in s.shards(code_of(s, right), shards).items():
            yield {"_block": block, "_shard": shard, "sizes": B.pack(np.array([len(x) for x in pieces], dtype=np.uint32)), "many": B.pack(np.array([len(x) - 2 for x in pieces.values()], dtype=np.uint32)), "keys": B.pack(np.array([x[0] for x in pieces.values()], dtype=np.uint64)), "again": B.pack(np.array([x[1] for x in pieces.values()], dtype=np.uint8)), "data": b"".join(pieces)}

    shipped = B.per_block_with(left, counted.repartition(back, "_block"), ship, "_block long, _shard long, sizes binary, many binary, keys binary, again binary, data binary")

    def sort(k: tuple, t: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        per_row, many, keys, again = [], [], [], []
        for sizes, c, k_, g, data in zip(*(t[n] for n in ("sizes", "many", "keys", "again", "data")), strict=True):
            view, at, mine = data.as_py(), 0, []
            for size, times, key_, self_ in zip(*(np.frombuffer(x.as_py(), dtype=w).tolist() for x, w in ((sizes, np.uint32), (c, np.uint32), (k_, np.uint64), (g, np.uint8))), strict=True):
                i = number.setdefault(view[at : at + size], len(number))
                if i == len(many):
                    many.append(0)
                    keys.append(key_)
                    again.append(self_)
                many[i] += times
                mine.append(i)
                at += size
            per_row.append(mine)
        pieces = [np.frombuffer(x, dtype=np.uint8) for x in number]
        own, times = np.array([len(x) for x in pieces], dtype=np.int64) - length + 1, np.array(many, dtype=np.int64)
        # a minimiser that has one string only, whose windows differ among themselves: its number says all
        _, back_, of_key = np.unique(np.array(keys, dtype=np.uint64), return_inverse=True, return_counts=True)
        sort_ = np.flatnonzero((of_key[back_] > 1) | np.array(again, dtype=bool))
        found = [np.full(o, m > 1) for o, m in zip(own.tolist(), many, strict=True)]
        if len(sort_):
            for i, x in zip(sort_.tolist(), repeated_in_parts([pieces[i] for i in sort_], times[sort_], np.array(keys, dtype=np.uint64)[sort_], length), strict=True):
                found[i] = x
        packed = [np.packbits(np.concatenate([found[i] for i in mine])).tobytes() for mine in per_row]
        B.trim()
        return pa.table({"_block": t["_block"], "_shard": t["_shard"], "bits": pa.array(packed, pa.binary())})

    sorted_ = shipped.repartition(min(shards, B.MOST_PARTS), "_shard").groupBy("_shard").applyInArrow(sort, "_block long, _shard long, bits binary")
    answer = sorted_.unionByName(counted.select("_block", (-1 - F.col("_bucket")).alias("_shard"), F.col("codes").alias("bits"))).repartition(back, "_block")
    names = [c for c in left.columns if c not in ("_t", "_block")]

    def remove(block: int, t: pa.Table, right: pa.Table) -> pa.Table:
        s = Segments(t["_t"], length)
        shard = right["_shard"].to_numpy()
        codes = right.filter(pa.array(shard < 0))
        codes = pa.table({"_bucket": pa.array(-1 - codes["_shard"].to_numpy()), "codes": codes["bits"]})
        bits = {k.as_py(): x.as_py() for k, x in zip(right["_shard"], right["bits"], strict=True) if k.as_py() >= 0}
        starts: dict[int, list[np.ndarray]] = {}
        for which, pieces in s.shards(code_of(s, codes), shards).items():
            flat, at = np.unpackbits(np.frombuffer(bits[which], dtype=np.uint8)).astype(bool), 0
            for raw, (_, _, *places) in pieces.items():
                own = len(raw) - length + 1
                hit = np.flatnonzero(flat[at : at + own])
                at += own
                if len(hit):
                    for d, a in places:
                        starts.setdefault(d, []).append(hit + a)
        rows = []
        for d, b in enumerate(s.docs):
            gone = covered(np.unique(np.concatenate(starts[d])), length, len(b)) if d in starts else np.zeros(len(b), dtype=bool)
            if whole_characters and d in starts:
                gone = whole(b, gone)
            spans = intervals(gone) if d in starts else []
            rows.append((len(b), int(gone.sum()), len(spans), spans, b[~gone].tobytes()))
        out = t.select(names)
        for name, values, kind in zip(("n_bytes", "n_removed", "n_spans", "removed", "kept"), zip(*rows, strict=True) if rows else ([], [], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()), strict=True):
            out = out.append_column(name, pa.array(list(values), kind))
        return out

    fields = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in names)
    return B.per_block_with(left, answer, remove, f"{fields}, n_bytes long, n_removed long, n_spans long, removed array<struct<first:bigint,last:bigint>>, kept binary").withColumnsRenamed(renamed)


def whole(b: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone without the bytes of characters that it holds in part only."""
    head = (b & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    char = np.maximum(char, 0)
    return (np.bincount(char, weights=~gone) == 0)[char]


def strip(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated strings cut out of the text, in whole characters; all columns kept, null texts stay null."""
    done = dedup(docs, length, key, text, whole_characters=True)
    return done.withColumn(text, F.when(F.col(text).isNotNull(), F.decode("kept", "utf-8"))).select(docs.columns)
