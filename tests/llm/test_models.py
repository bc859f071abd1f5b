"""Tokenizing, sharding, scoring and fingerprints against libraries, properties and brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, ctw, decontaminate, fingerprint, langid, sharding, toxicity

from .conftest import SCHEMA, frame

P = pytest.importorskip("public_tokenizers")
ODD = ["", None, "don't we'll  x\t\n\n y ", "<|endoftext|>a<|endoftext|>", "日本語 テキスト 123,45", "a\x1c\x1d b　c  d​", "😀😀 naïve\r\n", " " * 50 + "x", "z" * 3000, "ab" * 900 + "!?" * 300]


def test_bpe_is_the_library(spark, corpus):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ODD + corpus + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 1000), r.randrange(0x3000, 0x3100), 10])) for _ in range(200)) for _ in range(30)]
    encoded = bpe.encode(frame(spark, texts), path)
    ids = {x.doc_id: np.frombuffer(bytes(x.ids), dtype="<u4").tolist() for x in encoded.collect()}
    for i, t in enumerate(texts):
        assert ids[i] == library.encode(t or "", add_special_tokens=False).ids
    back = {x.doc_id: x.text for x in bpe.decode(encoded, path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    at_once = {x.doc_id: (bytes(x.ids), x.text) for x in bpe.encode(frame(spark, texts), path, decoded="text").collect()}
    assert at_once == {i: (np.array(ids[i], dtype="<u4").tobytes(), t or "") for i, t in enumerate(texts)}
    broken = spark.createDataFrame([(1, np.array([162, 99999, 50256], dtype="<u4").tobytes()), (2, None)], "k int, ids binary")
    assert {x.k: x.text for x in bpe.decode(broken, path).collect()} == {1: library.decode([162], skip_special_tokens=False) + "<|endoftext|>", 2: ""}


def test_bpe_words_beyond_the_broadcast_table(spark, corpus):
    path = P.path("byte_bpe_50k.json")
    packed = lambda df: sorted((x.doc_id, bytes(x.ids)) for x in df.select("doc_id", "ids").collect())
    df = frame(spark, ODD + corpus + corpus[:3])
    assert packed(bpe.encode(df, path, most=3)) == packed(bpe.encode(df, path))
    same = frame(spark, ["some words that come back"] * 4, ids=[1, 1, None, None])
    assert len({bytes(x.ids) for x in bpe.encode(same, path, most=1).collect()}) == 1


@pytest.mark.parametrize("size", [1, 7, 40])
def test_bpe_segments(spark, corpus, size):
    df = frame(spark, ODD + corpus).where("text is not null")
    special = ["<|endoftext|>"]
    found = lambda n: F.flatten(F.transform(bpe.segments(F.col("text"), special, n), lambda s: bpe.words(s, special)))
    assert df.where(found(size) != found(10**6)).count() == 0


def test_bpe_columns(spark):
    df = spark.createDataFrame([("x", 1.5, "a b")], "ids string, n double, text string")
    assert bpe.encode(df, P.path("byte_bpe_50k.json")).columns == ["n", "ids"]
    assert bpe.encode(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("bucket", [300, 8 << 20])
def test_shards(spark, corpus, bucket):
    df = frame(spark, corpus)
    rows = sharding.external_shuffle(df, 7, seed=3, bucket_bytes=bucket).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(corpus)))
    by = {}
    for r in rows:
        assert r.text == corpus[r.doc_id]
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.external_shuffle(df.repartition(3), 7, seed=3, bucket_bytes=bucket).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.external_shuffle(frame(spark, []), 7).count() == 0


def test_shards_keep_types(spark):
    df = spark.createDataFrame([(None, None, 2**60 + 1), (2**60 + 3, "x", None), (2**60 + 3, "x", None)], "doc_id long, text string, shard long")
    assert sorted(((r.doc_id or 0, r.text or "") for r in sharding.external_shuffle(df, 2).collect())) == [(0, ""), (2**60 + 3, "x"), (2**60 + 3, "x")]
    assert {r.doc_id for r in sharding.external_shuffle(df, 2).collect()} == {None, 2**60 + 3}


def test_toxicity(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    bad = ["badword", "awful", "nastier"]
    texts, marks = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(60)]
        if i % 5 == 0:
            w[r.randrange(60)] = r.choice(bad) + ","
        texts.append(" ".join(w).upper() if i % 7 == 0 else " ".join(w))
        marks.append((i, int(i % 5 == 0)))
    docs = frame(spark, [*texts, None, "", "badword"])
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 0)
    got = {x.doc_id: x for x in toxicity.score(docs, model, spark).collect()}
    held = [i for i in range(400) if i % 4 == 0]
    assert all(got[i].predicted == marks[i][1] for i in held)
    assert got[400].predicted == got[401].predicted == 0 and got[402].predicted == 1 and got[402].evidence
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.doc_id for x in toxicity.clean(docs, model, spark).collect()} == {i for i, x in got.items() if not x.predicted}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {x.score for x in toxicity.score(docs, nothing, spark).collect()} == {0.0}


def test_block_max_index_is_exact():
    r = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        t = r.choice(30, r.integers(1, 8), replace=False)
        w = r.random(len(t))
        vectors.append(dict(zip(t.tolist(), (w / np.linalg.norm(w)).tolist(), strict=True)))
    rows = np.repeat(np.arange(300), [len(v) for v in vectors])
    index = toxicity.BlockMaxIndex(rows, np.array([t for v in vectors for t in v]), np.array([w for v in vectors for w in v.values()]), 300, 30, 16)
    for v in vectors[:50]:
        t, w = np.array(sorted(v)), np.array([v[x] for x in sorted(v)])
        i, s = index.top(t, w, 10)
        exact = np.array([sum(v[x] * u.get(x, 0) for x in v) for u in vectors])
        assert np.allclose(s, np.sort(exact)[::-1][:10])
        assert np.allclose(exact[i], s)


def test_toxicity_score_is_that_of_all_cosines():
    """The whole score of a text, worked out without an index: every cosine, the nearest votes, the curve."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    rows, texts = [], []
    for i in range(300):
        w = [r.choice(words) for _ in range(r.randint(0, 40))] + ["vile"] * (i % 6 == 0)
        texts.append(" ".join(w))
        rows.append((str(i), *toxicity.features(texts[-1].encode()), int(i % 6 == 0 or i % 31 == 0)))
    texts[7] = texts[5]
    rows[7] = ("7", rows[5][1], rows[5][2], 1 - rows[5][3])
    model = toxicity.Model(rows, 9)
    n = len(rows)
    df, bad = {}, {}
    for _, f, _, y in rows:
        for h in f.tolist():
            df[h] = df.get(h, 0) + 1
            bad[h] = bad.get(h, 0) + y
    odds = sum(y for *_, y in rows) / n

    def weight(h):
        a, c = bad[h], df[h]
        gain = (a * math.log(a / c / odds) if a else 0) + ((c - a) * math.log((c - a) / c / (1 - odds)) if c > a else 0)
        return (math.log((1 + n) / (1 + c)) + 1) * (1 if 2 * gain > 2 * math.log(len(df)) + 5 else toxicity.WEAK)

    def unit(f, k):
        v = {h: (1 + math.log(x)) * weight(h) for h, x in zip(f.tolist(), k.tolist(), strict=True) if h in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {h: x / norm for h, x in v.items()}

    merged = {}
    for name, f, k, y in rows:
        v = unit(f, k)
        if v:
            slot = merged.setdefault(tuple(sorted((h, round(x, 9)) for h, x in v.items())), [v, [0, 0], name])
            slot[1][y] += 1
    share = [sum(s[1][y] for s in merged.values()) / sum(sum(s[1]) for s in merged.values()) for y in (0, 1)]
    for text in [*texts[:60], "vile", "unknown", "", "vile " + words[0]]:
        got, near = model.score(text.encode())
        v = unit(*toxicity.features(text.encode()))
        cosines = sorted(((round(sum(x * u.get(h, 0) for h, x in v.items()), 12), c) for u, c, _ in merged.values()), key=lambda x: -x[0])
        cosines = [x for x in cosines if x[0] > 0]
        if not cosines:
            assert got == model.prior and not near
            continue
        assert np.allclose([x.cosine if hasattr(x, "cosine") else x[1] for x in near], [x for x, _ in cosines[: toxicity.NAMED]])
        if len(cosines) > 9 and cosines[8][0] == cosines[9][0]:
            continue  # a tie at the edge goes by the index's order
        votes = [sum(x * c[y] for x, c in cosines[:9]) for y in (0, 1)]
        want = model.slope * math.log((votes[1] + share[1] + 1e-9) / (votes[0] + share[0] + 1e-9)) + model.offset
        assert math.isclose(got, 1 / (1 + math.exp(-want)), rel_tol=1e-6)


def test_language_and_mixture(spark):
    r = random.Random(6)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    speak = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, speak(k, 40), k) for i, k in enumerate(["aa", "bb", "cc"] * 10)]
    rows += [(30, None, "aa"), (31, "12 + 4", "aa"), (32, "", None), (33, speak("aa", 60) + " " + speak("bb", 30), None), (34, speak("cc", 3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    got = {x.doc_id: x for x in langid.identify(docs.drop("lang"), model, spark).collect()}
    assert all(got[i].lang_pred == k and got[i].score > 0.95 for i, _, k in rows[:30])
    assert [got[i].lang_pred for i in (30, 31, 32)] == ["und"] * 3
    assert [x.lang for x in got[33].languages] == ["aa", "bb"] and 0.55 < got[33].score < 0.8
    assert got[34].lang_pred == "cc"
    assert {x.lang_pred for x in langid.identify(docs, langid.fit(docs.limit(0)), spark).collect()} == {"und"}


def test_language_is_the_best_mixture(spark):
    """Counts and proportions against the plainest form: all trigrams in dictionaries, a grid instead of estimates."""
    r = random.Random(16)
    words = {"aa": "fee fie foe fum ffa", "bb": "fee gna gno goo fum", "cc": "lol lal lul élé là"}
    say = lambda k, n: " ".join(r.choice(words[k].split()) for _ in range(n))
    rows = [(i, say(k, r.randint(1, 30)), k) for i, k in enumerate(["aa", "bb", "cc"] * 8)] + [(24, say("aa", 30) + ", 5 " + say("cc", 12), None), (25, "zzz", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(t):
        flat = re.sub(rb" +", b" ", b" " + bytes(c if c > 127 or chr(c).isalpha() else 32 for c in t.lower().encode()) + b" ")
        return [flat[i : i + 3] for i in range(len(flat) - 2)]

    seen = {k: {} for k in words}
    for _, t, k in rows[:24]:
        for g in grams(t):
            seen[k][g] = seen[k].get(g, 0) + 1
    chance = lambda k, g: (seen[k].get(g, 0) + langid.SMOOTH) / (sum(seen[k].values()) + langid.SMOOTH * langid.KINDS)

    def best_of(t, names):
        g = grams(t)
        likely = lambda w: sum(math.log(sum(x * chance(k, i) for x, k in zip(w, names, strict=True))) for i in g)
        grid = [(1.0,)] if len(names) == 1 else [(i / 200, 1 - i / 200) for i in range(1, 200)] if len(names) == 2 else [(i / 50, j / 50, 1 - (i + j) / 50) for i in range(1, 49) for j in range(1, 50 - i)]
        w = max(grid, key=likely)
        return w, likely(w) - len(names) * 0.5 * math.log(len(g))

    for _, t, _ in rows:
        shares = dict(zip(words, best_of(t, list(words))[0], strict=True))
        order = sorted(words, key=lambda k: -shares[k])
        sets = [order[:n] for n in (1, 2, 3)]
        w, names = max(((best_of(t, s), s) for s in sets), key=lambda x: x[0][1])
        want = sorted(zip(names, w[0], strict=True), key=lambda x: -x[1])
        got = model.languages(t.encode())
        if len(grams(t)) > 20:
            assert [k for k, _ in got] == [k for k, _ in want] and all(abs(a[1] - b[1]) < 0.03 for a, b in zip(got, want, strict=True))


def test_context_tree_is_a_distribution_and_the_base_is_exact(spark, corpus):
    texts = [*corpus, "abcab", "abca"]
    docs = frame(spark, texts)
    train = F.col("doc_id") % 7 != 2
    got = {x.doc_id: x for x in ctw.score(docs, train, spark, block_bytes=6000).collect()}
    words = lambda t: [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    counts = {}
    for i, t in enumerate(texts):
        if i % 7 != 2:
            for w in [*words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        c = [counts.get(w, 0) for w in [*words(t), None]]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert math.isclose(got[i].base_score, sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel_tol=1e-9)
        assert got[i].score < 0
    one = {x.doc_id: x.score for x in ctw.score(docs, train, spark).collect()}
    assert all(math.isclose(one[i], got[i].score, rel_tol=1e-5) for i in one)


def test_score_is_context_tree_weighting(spark):
    """All trees built context by context, in the plainest way."""
    texts = ["abracadabra", "abra", "", None, "cadabra abr", "xyz", "abracad\u00e9"]
    depth = ctw.DEPTH
    raw = [(t or "").encode() for t in texts]
    counts = {}
    for i, b in enumerate(raw):
        if i % 3 != 2:
            padded = bytes(depth) + b + b"\0"
            for at in range(depth, len(padded)):
                for k in range(8):
                    node, bit = (1 << k) | (padded[at] >> (8 - k)), (padded[at] >> (7 - k)) & 1
                    for d in range(depth + 1):
                        counts.setdefault((node, padded[at - d : at]), [0, 0])[bit] += 1
    said = {}

    def log_kt(a, b):
        return sum(math.log((i + 0.5) / (i + 1)) for i in range(a)) + sum(math.log((i + 0.5) / (a + i + 1)) for i in range(b))

    def log_weighted(node, context):
        if (node, context) not in counts:
            return 0.0
        if (node, context) not in said:
            own = log_kt(*counts[node, context])
            said[node, context] = own if len(context) == depth else np.logaddexp(own, sum(log_weighted(node, bytes([c]) + context) for c in range(256))) - math.log(2)
        return said[node, context]

    def chance(node, context, past):
        n0, n1 = counts.get((node, context), (0, 0))
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if len(context) == depth:
            return own
        below = sum(log_weighted(node, bytes([c]) + context) for c in range(256))
        w = 1 / (1 + math.exp(below - log_kt(n0, n1)))
        return w * own + (1 - w) * chance(node, past[-len(context) - 1 :], past)

    got = {x.doc_id: x for x in ctw.score(frame(spark, texts), F.col("doc_id") % 3 != 2, spark, block_bytes=20).collect()}
    for i, b in enumerate(raw):
        padded, want = bytes(depth) + b + b"\0", 0.0
        for at in range(depth, len(padded)):
            for k in range(8):
                node, bit = (1 << k) | (padded[at] >> (8 - k)), (padded[at] >> (7 - k)) & 1
                p = chance(node, b"", padded[at - depth : at])
                want += math.log10(p if bit else 1 - p)
        assert math.isclose(got[i].score, want, rel_tol=1e-5), (i, got[i].score, want)
        assert math.isclose(got[i].bits_per_byte, -want / math.log10(2) / (len(b) + 1), rel_tol=1e-5)


def test_scores_without_training(spark):
    got = {x.doc_id: x for x in ctw.score(frame(spark, ["ab", None], ids=[1, 1]), F.lit(False), spark).collect()}
    assert math.isclose(got[1].bits_per_byte, 8, rel_tol=1e-6) and got[1].train_tokens == got[1].n_known == 0


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [say(r.randint(12, 40)) for _ in range(12)] + ["short", None, ""] + ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (9, 10, 13, 15, 16, 20, 23, 30, 31, 45, 79)]

    def damaged(t, n):
        t = list(t)
        for _ in range(n):
            at = r.randrange(len(t))
            t[at : at + 1] = r.choice([[], [r.choice("xyz")], [t[at], "q"]])
        return "".join(t)

    texts = [None, "", *(say(80) for _ in range(10))]
    for t in items[:12]:
        for n in (0, 3, len(t) // 12, len(t) // 8, len(t) // 4):
            texts.append(say(20) + ".\n" + damaged(t, n).upper() + "!! " + say(30))
    for t in items[15:]:
        for n in (0, 1, len(t) // 10, len(t) // 10 + 1):
            texts.append("xyz " + damaged(t, n) + " zyx")
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.matches(docs, bench, spark).collect()}
    plain = lambda t: decontaminate.normalise((t or "").encode())[0].tobytes().decode()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            m = plain(item)
            if m:
                k = len(m) // 10
                best = edit_distance_inside(m, plain(t))
                assert ((d, i) in got) == (best <= k), (d, i, best, k)
                assert got.get((d, i), best) == best
    kept = {x.doc_id for x in decontaminate.clean(docs, bench, spark).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}


def test_fingerprints(spark):
    r = random.Random(9)
    line = lambda: "".join(r.choice("abcdef") for _ in range(8))
    texts = [None, "", "a", "a\nb", "a\nb", "One thing. Another; a third", "One thing. Another; a fourth | x"]
    for n in (1, 5, 20, 60, 400, 6000):
        base = [line() for _ in range(n)]
        texts += ["\n".join(base), "\n".join([*base[:-1], line(), line()]), "\n".join(base)]
    rows = [(a, texts[(i + 1) % len(texts)]) for i, a in enumerate(texts)]
    df = spark.createDataFrame([(i, a or "", b or "") for i, (a, b) in enumerate(rows)], "doc_id long, text string, other string")
    names = lambda t: {x.k: x.p for x in spark.createDataFrame([(p,) for line in t.split("\n") for p in re.split(fingerprint.SENTENCE, line)], "p string").select(F.xxhash64("p").alias("k"), "p").collect()}
    got = {x.doc_id: x for x in fingerprint.compare(df, ["doc_id"], "text", "other", "other").collect()}
    for i, (a, b) in enumerate(rows):
        x, y = names(a or ""), names(b or "")
        assert math.isclose(got[i].near_next, len(x.keys() & y.keys()) / len(x.keys() | y.keys()))
        assert got[i].near_edited == got[i].near_next and got[i].n_chars == len(a or "")
        assert got[i].only_text == sorted(x.keys() - y.keys()) and got[i].only_edited == sorted(y.keys() - x.keys())
        assert got[i].edited_sha256 == hashlib.sha256((b or "").encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == ((a or "") == (b or ""))
    assert got[3].fingerprint == got[4].fingerprint != got[2].fingerprint


def test_fingerprints_of_nothing(spark):
    assert fingerprint.compare(fingerprint.with_next(frame(spark, [])).withColumn("e", F.col("text")), ["doc_id"], "text", "e", "_next").count() == 0
    clash = spark.createDataFrame([(1, "a", 5, 6), (None, "b", 7, 8), (1, "a", 5, 6)], "doc_id long, text string, _range int, _next_ int")
    assert sorted((r.doc_id or 0, r.text, r._next, r._range) for r in fingerprint.with_next(clash).collect()) == [(0, "b", "a", 7), (1, "a", "a", 5), (1, "a", "b", 5)]


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_next_document(spark, n):
    ids = [i * i for i in range(n)]
    df = frame(spark, [f"t{i}" for i in ids], ids=ids)
    got = {x.doc_id: x._next for x in fingerprint.with_next(df, rows_per_bucket=7).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{down[(i + 1) % n]}" for i, a in enumerate(down)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(empty, bench, spark).count() == decontaminate.clean(empty, bench, spark).count() == 0
    assert ctw.score(empty, F.lit(True), spark).count() == 0


def test_fit_hands_back_the_drivers_memory(spark, monkeypatch):
    docs = frame(spark, ["bad words here", "good words there", "bad things", "good things"])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    called = []
    monkeypatch.setattr(toxicity, "release", lambda: called.append(True))
    assert toxicity.fit(docs, labels).n == 4
    assert called
