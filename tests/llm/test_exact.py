"""Exact operators against brute-force versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import minhash, suffixarray
from tessera.llm import substring as sub
from tessera.llm._graph import components

from .conftest import SCHEMA, frame

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t):
    return SPACE.findall((t or "").encode())


def brute_windows(texts, k):
    seen = Counter(tuple(w[i : i + k]) for w in map(tokens, texts) for i in range(len(w) - k + 1))
    out = []
    for w in map(tokens, texts):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), b" ".join(kept)))
    return out


@pytest.mark.parametrize("k,block", [(35, 8 << 20), (5, 4000)])
def test_substring(spark, corpus, k, block):
    got = sub.dedup(frame(spark, corpus), k, block_bytes=block).collect()
    want = brute_windows(corpus, k)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_removed, bytes(r.kept)) == want[r.doc_id]
        assert sum(x.last - x.first for x in r.removed) == r.n_removed


def test_only_words_of_candidates_are_hashed_again(monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), None, "one two", " ".join(words[100:140]), " \n"]
    w = sub.Windows(pa.chunked_array([pa.array([(t or "").encode() for t in texts], pa.binary())]), 35, 1)
    whole = sub.window_hashes(sub.word_hashes(w.flat, w.starts, w.stops, 1), 35, 1)
    hashed, hashes = [], sub.word_hashes
    monkeypatch.setattr(sub, "word_hashes", lambda b, starts, ends, which=0: hashed.append(len(starts)) or hashes(b, starts, ends, which))
    at = np.array([0, 7, 2000, 2966])
    pairs = w.pairs(at)
    assert (pairs["lo"] == w.h[at]).all()
    assert pairs["hi"][:3].tolist() == whole[at[:3]].tolist() and pairs["hi"][3] == whole[w.words(at[3:])[0]]
    assert w.words(at[3:]).tolist() == [3002] and sum(hashed) <= 35 * len(at)


def brute_bytes(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(c for c, g in zip(b, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("n,block,hot", [(200, 8 << 20, 50_000), (40, 5000, 3)])
def test_suffix_array(spark, corpus, n, block, hot, monkeypatch):
    monkeypatch.setattr(suffixarray, "HOT", hot)
    got = suffixarray.dedup(frame(spark, corpus), n, block_bytes=block).collect()
    want = brute_bytes(corpus, n)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_suffix_array_keeps_whole_characters(spark):
    texts = ["é" * 150 + "a", "é" * 150 + "è", "b" * 50]
    for r in suffixarray.dedup(frame(spark, texts), whole_characters=True).collect():
        bytes(r.kept).decode()
    assert suffixarray.whole(np.frombuffer("aé".encode(), dtype=np.uint8), np.array([True, True, False])).tolist() == [True, False, False]


def test_suffix_ranks():
    r = np.random.default_rng(1)
    for _ in range(150):
        t = np.append(r.integers(1, r.integers(2, 6), r.integers(1, 60)), 0)
        sa = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert np.argsort(suffixarray.suffix_ranks(t, int(t.max()) + 1)).tolist() == sa
        common = suffixarray.permuted_lcp(t, np.array(sa), 5)
        for a, b in zip(sa, sa[1:], strict=False):
            x, y, n = t[a:].tolist(), t[b:].tolist(), 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert common[b] == min(n, 5)


def brute_classes(texts, k):
    sets = []
    for t in texts:
        w = tokens((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, corpus, k):
    got = minhash.near_duplicates(frame(spark, corpus), k).collect()
    want = brute_classes(corpus, k)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_without_a_centre(spark):
    """A chain: each text is near the next only, and all share buckets with some other."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 300, 8)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), 4).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_classes(texts, 4))}


def test_signature_estimates_similarity():
    r = np.random.default_rng(3)
    shared, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    equal = (minhash.signature(np.concatenate([shared, a])) == minhash.signature(np.concatenate([shared, b]))).mean()
    assert abs(equal - 0.8) < 0.15


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sub.dedup(empty).count() == suffixarray.dedup(empty).count() == minhash.near_duplicates(empty).count() == 0


def test_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1, "x"), (2, "a b c d e", None, "y"), (2, "a b c d e", None, "y")], "doc_id long, text string, n_removed int, kept string")
    assert sub.dedup(df, 3).count() == suffixarray.dedup(df, 16).count() == 3
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == {(None, 2, False), (2, 2, True)}


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_defeat_hashes_modulo_powers_of_two(spark):
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rest = " ".join(f"w{i}" for i in range(34))
    assert [r.n_removed for r in sub.dedup(frame(spark, [f"{one} {rest}", f"{two} {rest}"])).collect()] == [0, 0]
    pair = [f"{one} x y z", f"{two} x y z"]
    assert [r.component_id for r in sorted(minhash.near_duplicates(frame(spark, pair), 4).collect(), key=lambda r: r.doc_id)] == [0, 1]
    many = [" ".join(thue_morse(4096, *p).replace("a", "one ").replace("b", "two ").split()) for p in ("ab", "ba")]
    assert [r.n_removed for r in sub.dedup(frame(spark, many), 4096).collect()] == [0, 0]


def test_near_duplicates_of_any_ids(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [(None, base), ("b", base + " x"), ("a", base + " y"), ("a", "something else that is not alike"), (None, "on its own here now"), ("c", "")]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df, 4).collect()}
    assert got[None, 97] == got["b", 98] == ("a", False)
    assert got["a", 98] == got["a", 3] == ("a", True)
    assert got[None, 2] == (None, True) and got["c", 0] == ("c", True)
    assert sorted((r.doc_id or "", r.text) for r in minhash.deduplicate(df, 4).collect()) == sorted((i or "", t) for i, t in texts if i != "b")


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    r = np.random.default_rng(8)
    pairs = [(i, i + 1) for i in range(40)] + [tuple(map(int, r.integers(100, 200, 2))) for _ in range(45)]
    got = {x.id: x.component for x in components(spark.createDataFrame(pairs, "a long, b long"), one_task).collect()}
    label = {i: i for p in pairs for i in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_digest():
    assert sub.digest(b"a") == hashlib.sha256(b"a").hexdigest()


def common_phrase(documents):
    """Segments of documents that share a phrase of 130 bytes in contexts of their own."""
    r = np.random.default_rng(3)
    letters = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes()
    phrase = letters(130)
    return pa.chunked_array([pa.array([letters(150) + phrase + letters(150) for _ in range(documents)], pa.binary())])


def test_hot_minimisers_are_cut_into_few_bytes():
    s = suffixarray.Segments(common_phrase(300), 200)
    code = np.full(len(s.key), 2, dtype=np.uint8)
    shards = s.shards(code, 64)
    assert sum(len(x) for pieces in shards.values() for x in pieces) < 4 * sum(int(n) + 199 for n in s.own)
    windows = sorted((d, a + i) for pieces in shards.values() for raw, (_, _, *places) in pieces.items() for d, a in places for i in range(len(raw) - 199))
    assert windows == sorted((int(d), int(a) + i) for d, a, n in zip(s.doc, s.first, s.own, strict=True) for i in range(n))


@pytest.mark.parametrize("most", [1 << 20, 6000, 300])
def test_shards_are_sorted_in_parts(monkeypatch, most):
    texts = [x.as_py() for x in common_phrase(60)]
    texts += [texts[3], texts[5][:320], b"ab" * 200, b"ab" * 150]
    s = suffixarray.Segments(pa.chunked_array([pa.array(texts, pa.binary())]), 200)
    pieces = [np.frombuffer(s.content(i), dtype=np.uint8) for i in range(len(s.key))]
    held, repeated = [], suffixarray.repeated
    monkeypatch.setattr(suffixarray, "PART", most)
    monkeypatch.setattr(suffixarray, "repeated", lambda p, *a: (held.append(sum(map(len, p))), repeated(p, *a))[1])
    got = suffixarray.repeated_in_parts(pieces, np.ones(len(pieces), dtype=np.int64), s.key, 200)
    seen = Counter(bytes(x[i : i + 200]) for x in pieces for i in range(len(x) - 199))
    assert all(g.tolist() == [seen[bytes(x[i : i + 200])] > 1 for i in range(len(x) - 199)] for g, x in zip(got, pieces, strict=True))
    assert max(held) <= max(most, 3000)
