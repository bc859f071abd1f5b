"""Operators without an SQL form against the plainest Python, over the whole output."""

from __future__ import annotations

import os
import random
from decimal import Decimal, localcontext
from difflib import SequenceMatcher
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions.similarity import indel
from tessera.operators import align, candidates, clusters, diffs, facts, graph, pages, rules, tasks, units
from tessera.plans import compare, draft
from tessera.plans.queries import QUERIES

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def sql(text):
    return duckdb.sql(text.format(d=DATA)).fetchall()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


# --- order-dependent folds over the driver's tables ------------------------------------------------


@needs_data
def test_deoverlap(spark):
    rows = sql("select user_id, event_id, event_id + cast(floor(value) as bigint), length(event_type), event_type from '{d}/events.parquet'")
    by = {}
    for u, a, z, p, k in rows:
        by.setdefault(u, []).append((a, -p, z, k))
    want = []
    for u, spans in by.items():
        done = []
        for a, low, z, k in sorted(spans):
            if not any(x < z and a < y and q <= low for x, q, y, _ in done):
                done.append((a, low, z, k))
        want += [(u, a, z, -low, k) for a, low, z, k in done]
    got = [(r.user_id, r["first"], r["last"], r.priority, r.event_type) for r in QUERIES["q_deoverlap"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def line_diffs():
    out = {}
    for doc, text in sql("select doc_id, text from '{d}/documents.parquet'"):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                out.setdefault(doc, []).append((i, ("DELETED", "ADDED", "DELETED", "MODIFIED")[i % 4], line))
    return out


@needs_data
def test_merge_deletions(spark):
    want = []
    for doc, rows in line_diffs().items():
        done = []
        for i, kind, text in rows:
            if kind == "DELETED":
                if done and 0 <= i - done[-1][1] <= 1:
                    done[-1][2].append(text)
                else:
                    done.append((i, i, [text]))
        want += [(doc, i, p, "\n".join(t), len(t)) for i, p, t in done]
    got = [(r.pair, r.ordinal, r.paragraph, r.text, r.n) for r in QUERIES["q_merge_deletions"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


@needs_data
def test_recompose(spark):
    want = []
    for doc, rows in line_diffs().items():
        i = 0
        while i < len(rows):
            at, kind, text = rows[i]
            if i + 1 < len(rows) and {kind, rows[i + 1][1]} == {"DELETED", "ADDED"} and ratio(text, rows[i + 1][2]) >= 72:
                pair = (text, rows[i + 1][2]) if kind == "DELETED" else (rows[i + 1][2], text)
                want.append((doc, at, "MODIFIED", *pair))
                i += 2
            else:
                want.append((doc, at, kind, text if kind == "DELETED" else None, text if kind == "ADDED" else None))
                i += 1
    got = [(r.pair, r.ordinal, r.kind, r.before, r.after) for r in QUERIES["q_recompose"](spark, DATA).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@needs_data
def test_clique_pack(spark):
    docs = sql("select doc_id, md5(text), md5(split_part(text, chr(10), 1)) from '{d}/documents.parquet' order by doc_id")
    first, edges = [{}, {}], set()
    for i, *keys in docs:
        for seen, k in zip(first, keys, strict=True):
            if seen.setdefault(k, i) != i:
                edges.add((seen[k], i))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, unseen = [], set(near)
    while unseen:
        part, todo = set(), [min(unseen)]
        while todo:
            n = todo.pop()
            if n not in part:
                part.add(n)
                todo += near[n]
        unseen -= part
        want += [tuple(g) for g in graph.pack_cliques(sorted(part), {e for e in edges if e[0] in part}, 4)]
    got = [tuple(r.members) for r in QUERIES["q_clique_pack"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def best_packing(nodes, edges, most):
    whole = [g for n in range(2, most + 1) for g in combinations(sorted(nodes), n) if all(tuple(sorted(p)) in edges for p in combinations(g, 2))]
    whole = [g for g in whole if not any(set(g) < set(h) for h in whole)]
    best = None
    for n in range(len(nodes) // 2 + 1):
        for some in combinations(whole, n):
            if sum(map(len, some)) == len(set().union(*some)):
                key = (-sum(map(len, some)), tuple(-len(g) for g in sorted(some, key=len, reverse=True)), tuple(sorted(some)))
                best = min(best, key) if best else key
    return list(best[2])


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_the_best(seed):
    r = random.Random(seed)
    nodes = list(range(8))
    edges = {p for p in combinations(nodes, 2) if r.random() < 0.45}
    assert graph.pack_cliques(nodes, edges, 4) == best_packing(nodes, edges, 4)


def test_large_components_take_the_largest_groups_first():
    nodes = list(range(30))
    edges = {p for g in ([5, 6, 7, 8], [0, 5], [1, 6], [20, 21, 22], [22, 23]) for p in combinations(g, 2)}
    assert graph.pack_cliques(nodes, edges, 4) == [(5, 6, 7, 8), (20, 21, 22)]


# --- tables ---------------------------------------------------------------------------------------


def order_tables():
    rows = sql("select l_orderkey, l_linenumber, min(l_linestatus), min(l_quantity), min(l_returnflag) from '{d}/lineitem.parquet' group by all")
    a, b = {}, {}
    for key, n, status, quantity, flag in rows:
        texts = [str(n), status, str(int(quantity)), "" if n % 2 == 0 else flag]
        a.setdefault(key, {})[n - 1] = texts
        if not (key % 3 == 0 and n - 1 == 2):
            b.setdefault(key, {})[n - 1] = [*texts[:2], texts[2] + ("0" if key % 5 == 0 else ""), texts[3]]
    return a, b


@needs_data
def test_column_map(spark):
    a, b = order_tables()
    want = []
    for key in a.keys() & b.keys():
        x, y = (t[key][min(t[key])] for t in (a, b))
        once = lambda h: {t: i for i, t in enumerate(h) if t and h.count(t) == 1}
        p, q = once(x), once(y)
        named = [(p[t], q[t]) for t in p.keys() & q.keys()]
        left = [i for i in range(4) if i not in {c for c, _ in named}]
        right = [i for i in range(4) if i not in {c for _, c in named}]
        want += [(key, i, j, True) for i, j in named] + [(key, i, i, False) for i in left if i in right]
    got = [(r.table, r.old_col, r.new_col, r.reliable) for r in QUERIES["q_column_map"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


@needs_data
def test_match_tables(spark):
    a, _ = order_tables()
    pairs = {}
    for key, rows in a.items():
        t = pairs.setdefault(key // 64, {}).setdefault(key % 8, {})
        for n, texts in rows.items():
            t[n + 10 * (key // 8)] = texts
    want = []
    for pair, tables_ in pairs.items():
        head = {t: "|".join(rows[min(rows)]) for t, rows in tables_.items()}
        found = sorted((-ratio(head[t], head[u]), t, u) for t in head for u in head if u != 3 and abs(len(tables_[t]) - len(tables_[u])) <= max(3, 0.2 * max(len(tables_[t]), len(tables_[u]))) and ratio(head[t], head[u]) >= 80)
        used = (set(), set())
        for s, t, u in found:
            if t not in used[0] and u not in used[1]:
                used[0].add(t)
                used[1].add(u)
                want.append((pair, t, u, round(-s, 9)))
    got = [(r.pair, r.old, r.new, round(r.similarity, 9)) for r in QUERIES["q_match_tables"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)


# --- similarity and candidates --------------------------------------------------------------------


@needs_data
def test_similarities(spark):
    parts = {k: (n, t, b) for k, n, t, b in sql("select p_partkey, p_name, p_type, p_brand from '{d}/part.parquet'")}

    def partial(x, y):
        short, long_ = sorted((x, y), key=len)
        return max(ratio(short, long_[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long_)))

    def blocks(x, y):
        return min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else SequenceMatcher(None, x, y, autojunk=False).ratio()

    for r in QUERIES["q_similarity"](spark, DATA).collect():
        name, kind, brand = parts[r.p_partkey]
        assert r.indel == pytest.approx(ratio(name, kind)) and r.blocks == pytest.approx(blocks(name, brand))
        assert r.partial == pytest.approx(partial(name, kind) if len(name) != len(kind) else max(partial(name, kind), partial(kind, name)))


@needs_data
def test_document_similarity(spark):
    from tessera.plans.queries import versions

    sides = [{}, {}]
    for side, u in zip(sides, versions(spark, DATA), strict=True):
        for r in u.collect():
            side.setdefault(r.pair, []).append((r.ordinal, r.text))
    got = {r.pair: r.similarity for r in QUERIES["q_document_similarity"](spark, DATA).collect()}
    assert got.keys() == sides[0].keys() & sides[1].keys()
    text = lambda side, k: "".join(t for _, t in sorted(side[k]))
    small = [k for k in got if len(text(sides[0], k)) < 1500]
    assert len(small) > 50
    for k in small:
        assert got[k] == pytest.approx(ratio(text(sides[0], k), text(sides[1], k)))


def test_numeric_spans(spark):
    text = "合同编号：AB-12/x 金额1,234.5元，第3条 期限 12 个月 税率 5 ％ 2024年1月2日 共7台 8"
    got = {(r.kind, r.raw, r["first"], r["last"], r.keep) for r in candidates.spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "d long, text string"), ["d"]).collect()}
    import re

    want = set()
    for kind, (_, pattern) in candidates.KINDS.items():
        for m in re.finditer(pattern, text):
            a, z = m.span(m.re.groups)
            structural = kind != "IDENTIFIER" and re.search(candidates.STRUCTURAL, text[max(0, a - 8) : a])
            bare = kind == "NUMBER" and not re.search(candidates.AMOUNT_WORDS, text[max(0, a - 16) : z + 16])
            want.add((kind, text[a:z], a, z, not (structural or bare)))
    assert got == want


# --- alignment ------------------------------------------------------------------------------------


def plain_alignment(left, right):
    """The score of the best path over all cells, without a band or bounds."""
    import re

    n, m = len(left), len(right)
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            here = best.get((i, j), float("-inf"))
            moves = [(i + 1, j, align.GAP)] * (i < n) + [(i, j + 1, align.GAP)] * (j < m)
            for a in range(1, min(4, n - i) + 1):
                for b in range(1, min(4, m - j) + 1):
                    x, y = "".join(t for t, _ in left[i : i + a]), "".join(t for t, _ in right[j : j + b])
                    s = indel(x, y) / 100
                    p, q = re.sub(align.NUMBER, "#", x), re.sub(align.NUMBER, "#", y)
                    near = {c for _, c in left[i : i + a] if c} & {c for _, c in right[j : j + b] if c} or ((p != x or q != y) and indel(p, q) >= 80)
                    if s >= align.LEAST or (s >= align.LEAST_ALIKE and near):
                        moves.append((i + a, j + b, 1 + s - align.EXTRA * (a + b - 2)))
            for to_i, to_j, gain in moves:
                best[to_i, to_j] = max(best.get((to_i, to_j), float("-inf")), here + gain)
    return best[n, m]


@pytest.mark.parametrize("seed", range(8))
def test_alignment_is_the_best(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde12") for _ in range(r.randint(2, 9)))
    left = [(word(), r.choice([None, "1.", "2."])) for _ in range(r.randint(0, 26))]
    right = [(t[: r.randint(1, len(t))] + r.choice(["", "9"]), c) if r.random() < 0.3 else (t, c) for t, c in left if r.random() < r.choice([0.4, 0.9])]
    for _ in range(r.randint(0, 12)):
        right.insert(r.randint(0, len(right)), (word(), None))
    steps = list(align.align_units(left, right))
    value = sum(1 + s - align.EXTRA * (a + b - 2) if a and b else align.GAP * (a + b) for _, a, _, b, s in steps)
    assert value == pytest.approx(plain_alignment(left, right))
    assert [i for i0, a, _, _, _ in steps for i in range(i0, i0 + a)] == list(range(len(left)))
    assert [j for _, _, j0, b, _ in steps for j in range(j0, j0 + b)] == list(range(len(right)))


@pytest.mark.parametrize("seed", range(6))
def test_longest_chain(seed):
    r = random.Random(seed)
    pairs = list({(r.randrange(14), r.randrange(14)) for _ in range(20)})
    chain = align.longest_chain(pairs)
    rises = lambda c: all(a[0] <= b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))
    assert set(chain) <= set(pairs) and rises(chain)
    assert not any(rises(sorted(c)) for c in combinations(sorted(pairs), len(chain) + 1))


def test_page_spans_are_all_that_count():
    r = random.Random(4)
    say = lambda n: "".join(r.choice("abcdefg") for _ in range(n))
    external = [say(r.randint(0, 30)) for _ in range(40)]
    local = ["".join(external[i : i + k]) for i, k in ((0, 1), (3, 2), (9, 3))] + [external[20][:-2] + "xy", say(25), ""]
    found = pages._spans(local, external)
    for text, runs in zip(local, found, strict=True):
        for j in range(len(external)):
            want = []
            for k in range(1, min(pages.SPAN, len(external) - j) + 1):
                run = "".join(external[j : j + k])
                if text and run:
                    s = min(len(text), len(run)) / max(len(text), len(run)) if text in run or run in text else SequenceMatcher(None, text, run, autojunk=False).ratio()
                    if s >= (pages.ALIKE_LONG if k == 1 and len(text) >= pages.LONG else pages.ALIKE):
                        want.append((j + k, pytest.approx(s)))
            assert runs.get(j, []) == want


def test_tables_find_their_pages():
    cells = [["name", "amount", "a", "10", "b", "20"], ["x1", "x2", "x3", "x4"], ["only here"]]
    external = [("PARAGRAPH", ["intro"]), ("TABLE", ["name", "amount", "a", "10"]), ("TABLE", ["b", "20", "zz"]), ("PARAGRAPH", ["x1x2"]), ("PARAGRAPH", ["x3x4"])]
    assert pages.align_table_cells(cells, external) == [(0, 1, 3), (1, 3, 5)]


def test_sidecar(spark):
    p = spark.createDataFrame([(1, 0, "the first words here"), (1, 2, "nothing like it"), (1, 3, "the last words here")], "file long, ordinal long, text string")
    x = spark.createDataFrame([(1, 0, "the first words here", 4), (1, 1, "the last words here", 4)], "file long, ordinal long, text string, page int")
    t = spark.createDataFrame([(1, 1, ["one", "two"]), (1, 9, ["lost", "cells"])], "file long, ordinal long, cells array<string>")
    b = spark.createDataFrame([(1, 5, "TABLE", ["one", "two"], 6)], "file long, ordinal long, type string, cells array<string>, page int")
    got = {r.ordinal: (r.pages, r.how) for r in pages.sidecar(p, x, t, b).collect()}
    assert got == {0: ([4], "ALIGNED"), 1: ([6], "ALIGNED"), 2: (None, None), 3: ([4], "ALIGNED"), 9: (None, None)}


# --- comparison -----------------------------------------------------------------------------------


def test_comparison(spark):
    old = {1: [f"clause number {i} says something of its own" for i in range(12)], 2: ["alpha beta", "gamma"], 3: ["same text"] * 3}
    new = {1: old[1][:3] + old[1][5:9] + ["clause number 9 says something of mine"] + old[1][10:], 2: ["omega psi chi", "zz"], 3: ["same text"] * 3}
    rows = lambda side: spark.createDataFrame([(p, i, t.replace(" ", ""), None) for p, ts in side.items() for i, t in enumerate(ts)], "pair long, ordinal long, text string, clause string")
    made = compare.compare(rows(old), rows(new))
    d = {r.pair: r for r in made["diagnostics"].collect()}
    assert (d[1].base_units, d[1].target_units, d[1].explained, d[1].reliable) == (12, 10, 2, True)
    assert d[1].effective_base_coverage == pytest.approx(1.0) and d[1].base_coverage < 1
    assert d[2].reasons == ["DOCUMENT_PAIR_UNRELATED"] and not d[2].reliable
    assert d[3].similarity == 1 and d[3].reliable and d[3].diffs == 0
    diffs = sorted((r.pair, r.kind, r.diff_id) for r in made["diffs"].collect())
    assert diffs == [(1, "CONTENT_BLOCK_MISSING", "diff_000001"), (1, "NUMERIC_CHANGED" if False else "MODIFIED", "diff_000002")]
    texts = spark.createDataFrame([(p, n, "".join(ts)) for n, side in enumerate((old, new)) for p, ts in side.items()], "pair long, doc int, text string")
    res = {r.pair: r for r in compare.result(made, texts, {"LETTER": "[a-z]", "DIGIT": "[0-9]"}).collect()}
    assert set(res) == {1, 3}
    assert (res[1].conclusion, res[1].risk_count, res[3].conclusion, res[3].passed_count) == ("RISK_FOUND", 2, "PASS", 1)
    codes = {(r.pair, r.code) for r in made["warnings"].collect()}
    assert (2, "DOCUMENT_PAIR_UNRELATED") in codes and (1, "RULE_BASED_LIMITATION") in codes


def test_template(spark):
    old = [f"clause {i} says something of its own kind" for i in range(8)] + ["rent____monthly", "name____"]
    new = [*old[:3], old[3] + " and more", *old[4:8], "rent500monthly", "name____"]
    rows = lambda ts: spark.createDataFrame([(1, i, t, None) for i, t in enumerate(ts)], "pair long, ordinal long, text string, clause string")
    cells = lambda ts: spark.createDataFrame([(1, 0, r, c, t) for (r, c), t in ts.items()], "doc long, table int, row int, col int, text string")
    asked = {(0, 0): "name", (0, 1): "", (1, 0): "sum", (1, 1): ""}
    made = draft.template_analysis(rows(old), rows(new), cells(asked), cells(asked | {(0, 1): "x"}))
    assert [(r.before, r.after) for r in made["allowed"].collect()] == [("rent____monthly", "rent500monthly")]
    items = draft.template_items(made)
    got = {(r.kind, r.code, r.ref) for r in items.collect()}
    assert got == {("RISK", "TEMPLATE_MODIFIED", "diff_000001"), ("RISK", "UNFILLED_BLANK", "9"), ("RISK", "REQUIRED_CELL_EMPTY", "0/1/1")}
    votes = spark.createDataFrame([(1, "UNFILLED_BLANK", "9", True), (1, "UNFILLED_BLANK", "9", False)], "review long, code string, ref string, confirmed boolean")
    settled = {(r.code, r.kind) for r in draft.consensus(items, votes).collect()}
    assert ("UNFILLED_BLANK", "REVIEW") in settled and ("TEMPLATE_MODIFIED", "RISK") in settled


def test_published(spark):
    rows = [
        (1, "d1", "DELETED", "rent is due", None, 1), (1, "d2", "ADDED", None, "rent is due", 9), (1, "d3", "DELETED", "不得转租", None, 1), (1, "d4", "ADDED", None, "不得转租", 2),
        (1, "d5", "ADDED", None, "13", 3), (1, "d6", "DELETED", "page head", None, 4), (1, "d7", "MODIFIED", "with a page head in it", "other", 5), (1, "d8", "ADDED", None, "far page head", 8),
    ]
    df = spark.createDataFrame([(*r, None, None, "c") for r in rows], "pair long, diff_id string, kind string, before string, after string, page int, table_pair string, field string, chapter string")
    made = clusters.published(df)
    assert [r.diff_id for r in made["kept"].orderBy("published_id").collect()] == ["d3", "d4", "d7", "d8"]
    assert {(r.reason, tuple(r.removed)) for r in made["audit"].collect()} == {("EQUIVALENT_NO_CHANGE", ("d1", "d2")), ("BOUNDARY_NOISE", ("d5",)), ("BOUNDARY_NOISE", ("d6",))}
    safe = clusters.residual_safe(df.select("pair", "diff_id"), spark.createDataFrame([(1, "d1", "以及", False), (1, "d2", "a sentence", False), (1, "d3", "Title", True)], "pair long, diff_id string, text string, heading boolean"))
    assert {r.diff_id: r.safe for r in safe.collect()}["d2"] is False and all(r.safe for r in safe.where("diff_id <> 'd2'").collect())


def test_equal_formulas_stay_published(spark):
    rows = [(1, "d1", "DELETED", "token=9a", None, 1), (1, "d2", "ADDED", None, "token=9a", 4), (1, "d3", "DELETED", "rent is due", None, 7), (1, "d4", "ADDED", None, "rent is due", 9)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "pair long, diff_id string, kind string, before string, after string, page int, table_pair string, field string, chapter string")
    made = clusters.published(df)
    assert [(r.diff_id, r.published_id) for r in made["kept"].orderBy("diff_id").collect()] == [("d1", "diff_000001"), ("d2", "diff_000002")]
    s = made["stats"].first()
    assert (s.raw_candidate_count, s.equivalent_filtered_count, s.equivalent_group_count, s.final_published_risk_count) == (4, 2, 1, 2)
    assert [tuple(r.removed) for r in made["audit"].collect()] == [("d3", "d4")]


# --- facts, units, rules, tasks -------------------------------------------------------------------


def test_named_models(spark):
    rows = [("a", "v", 2, ["p2"], ["x"], 0.5), ("a", "v", 1, ["p1", "p2"], ["y"], 0.9), ("b", "v", 1, [], [], 0.1), ("b", "w", 2, [], [], 0.2)]
    df = spark.createDataFrame(rows, "id string, v string, seq int, places array<string>, aliases array<string>, confidence double")
    got = {r.id: (r.v, r.conflict, r.places, r.aliases, r.confidence) for r in facts.merge_named(df, "id", "v", strict=False).collect()}
    assert got == {"a": ("v", False, ["p1", "p2"], ["y", "x"], 0.9), "b": (None, True, [], [], 0.2)}
    with pytest.raises(Exception, match="conflicting duplicate"):
        facts.merge_named(df, "id", "v").collect()


def test_chunk_facts(spark):
    df = spark.createDataFrame([("f", "k", "T", "p", "one", 2), ("f", "k", "T", "p", "one", 1), ("f", "k", "T", "q", "two", 3)], "file string, field string, kind string, place string, value string, seq int")
    assert sorted((r.place, r.value, r.seq) for r in facts.merge_chunk_facts(df).collect()) == [("p", "one", 1), ("q", "two", 3)]
    with pytest.raises(Exception, match="FACT_IDENTITY_CONFLICT"):
        facts.merge_chunk_facts(df.withColumn("value", F.col("seq").cast("string"))).collect()


def test_pieces(spark):
    texts = ["一句。二句！三", "a, b, c", "twelve words", "123456", "12 345", "x", "", "ab"]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", units.pieces(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [["一句。", "二句！", "三"], ["a,", "b,", "c"], ["twelve", "words"], [], ["12", "345"], [], [], ["a", "b"]]


def test_numeric_units(spark):
    df = spark.createDataFrame([("u", [0], "1, 2, 3, 4 。 5 6"), ("v", [1], "7890")], "k string, path array<int>, text string")
    got = sorted((r.k, r.path, r.text, r.too_large) for r in units.numeric_units(df, 1).collect())
    assert [t for k, _, t, _ in got if k == "u"] == ["1,", "2,", "3,", "4 。", "5", "6"]
    assert [x[1:] for x in got if x[0] == "v"] == [([1], "7890", False)]


def test_exact_products(spark):
    rule = lambda op: {"op": "equals", "left": {"op": op, "args": [{"op": "fact", "concept_id": "a"}, {"op": "fact", "concept_id": "b"}]}, "right": {"op": "literal", "value": "0"}}
    r = random.Random(3)
    for _ in range(15):
        a, b = (Decimal(r.randrange(-(10**13), 10**13)).scaleb(-r.randrange(11)) for _ in range(2))
        row = spark.createDataFrame([(a, b)], "a decimal(38,10), b decimal(38,10)")
        fact = lambda ref: F.col(ref[0])
        got = {op: row.select(rules.compile_rule(rule(op)["left"], fact).alias("v")).first().v for op in ("multiply", "divide", "add", "subtract")}
        with localcontext(prec=60):
            assert abs(got["multiply"] - a * b) <= Decimal("2e-10") and got["add"] == a + b and got["subtract"] == a - b
            assert b == 0 or abs(got["divide"] - a / b) <= Decimal("1e-10")


@pytest.mark.parametrize("size", [3, 1000])
def test_islands_over_ranges(spark, size):
    r = random.Random(2)
    rows = sorted({(r.choice(["a", "b", None]), r.randrange(300)) for _ in range(200)}, key=str)
    got = {(x.k, x.n): x.run for x in diffs.islands(spark.createDataFrame(rows, "k string, n int"), ["k"], "n", 3, size).collect()}
    for k in ("a", "b", None):
        last, run = None, 0
        for n in sorted(n for key, n in rows if key == k):
            run += last is None or n - last > 3
            assert got[k, n] == run
            last = n


@pytest.mark.parametrize("n", [1, 65, 100])
def test_long_chains_have_one_root(spark, n):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(1000, 1001), (1001, 1000)], "id long, source_task_id long")
    got = {r.id: (r.root, r.steps) for r in tasks.lineage(df).collect()}
    assert all(got[i] == (0, i) for i in range(n)) and got[1000] == got[1001] == (None, None)


def test_quotes_with_marks(spark):
    d = spark.createDataFrame([(1, r"a.\Eb a.\Eb aaa"), (2, "aaaa")], "k long, text string")
    q = spark.createDataFrame([(1, r".\Eb"), (2, "aa")], "k long, quote string")
    assert {r.k: (r.hits, r["first"]) for r in facts.quote_hits(q, d).collect()} == {1: (2, 1), 2: (3, 0)}
    with pytest.raises(ValueError, match="share a column"):
        facts.quote_hits(q.select("quote"), d.select("text"))


def test_bounded_common_subsequence():
    r = random.Random(11)
    for _ in range(300):
        letters = "abcdefghij"[: r.choice([2, 4, 10])]
        a = [r.choice(letters) for _ in range(r.randrange(200))]
        b = [r.choice(letters) if r.random() < 0.3 else c for c in a if r.random() < 0.9] if r.random() < 0.6 else [r.choice(letters) for _ in range(r.randrange(200))]
        a, b = "".join(a), "".join(b)
        whole = sim.lcs_length(a, b)
        for need in (0, whole - 1, whole, whole + 1, len(b), len(a) + 1):
            assert sim.lcs_at_least(sim.places(a), len(a), b, need) == (whole if whole >= need else None)
    # texts that cannot be alike are given up early
    at, read = sim.places("ab" * 400), []
    class Watched(str):  # noqa: E301
        def __getitem__(self, i):
            read.append(i)
            return str.__getitem__(self, i)
    assert sim.lcs_at_least(at, 800, Watched("c" * 800), 600) is None and len(read) <= 4  # noqa: E305


def test_table_cells_are_compared_once(monkeypatch):
    r, asked, alike = random.Random(7), [], pages._alike
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    tables = [[r.choice(words) for _ in range(40)] for _ in range(8)]
    external = [("TABLE", [w for w in t if r.random() < 0.9]) for t in tables]

    def ordered(cells, others):
        at, scores = 0, []
        for text in cells:
            j = next((j for j in range(at, len(others)) if alike(text, others[j], pages.ALIKE) >= pages.ALIKE), None)
            if j is not None:
                scores.append(alike(text, others[j], pages.ALIKE))
                at = j + 1
        return len(scores), sum(scores) / len(scores) if scores else 0.0

    known = pages._Cells(external)
    for cells in tables:
        for a, z in combinations(range(9), 2):
            assert known.ordered([known.alike(x) for x in cells], a, z) == ordered(cells, [x for _, t in external[a:z] for x in t])
    monkeypatch.setattr(pages, "_alike", lambda a, b, *x: (asked.append((a, b)), alike(a, b, *x))[1])
    assert pages.align_table_cells(tables, external)
    assert len(asked) == len(set(asked)) <= len(set(words)) ** 2


def test_cogrouped_kernels_take_many_groups_at_once(spark):
    from tessera.operators._grouped import cogrouped

    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (None, 1, "n")], "k long, ordinal long, x string")
    b = spark.createDataFrame([(1, 5, [1]), (3, 1, [2, 3]), (None, 9, None)], "k long, ordinal long, y array<int>")
    made = cogrouped(a, b, ["k"], lambda p, q: [("".join(r["x"] for r in p), [r["y"] for r in q])] * (1 if p else 2), "s string, l array<array<int>>")
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, [(1, "ab", [[1]]), (2, "c", []), (None, "n", [None]), (3, "", [[2, 3]]), (3, "", [[2, 3]])]))
    assert cogrouped(a.limit(0), b.limit(0), ["k"], lambda p, q: [("", [])], "s string, l array<array<int>>").count() == 0
    units = spark.createDataFrame([(p, i, t, None) for p in range(3) for i, t in enumerate(["one line", "two lines", "three lines"])], "pair long, ordinal long, text string, clause string")
    steps = compare.version_diffs(units, units.where("ordinal <> 1"))
    assert {(r.pair, r.kind, r.before) for r in steps.collect()} == {(p, "DELETED", "two lines") for p in range(3)}
    plan = align.align(units, units, align.monotone(align.unique_anchors(units, units)))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


@pytest.mark.parametrize("most", [1 << 17, 5, 0])
def test_similar_sets_by_first_tokens(spark, monkeypatch, most):
    monkeypatch.setattr(facts, "RANKED", most)
    r = random.Random(13)
    sets = [[r.choice(["the", "of"]), *(f"w{r.randrange(30)}" for _ in range(r.randrange(12)))] for _ in range(80)]
    sets += [[*s[:-1], "new"] for s in sets[:40]] + [sets[3], sets[3][::-1], [], ["alone"], ["alone"]]
    d = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    classes = {}
    for i, s in enumerate(sets):
        if s:
            classes.setdefault(frozenset(s), []).append(i)
    want = {(i, m[0], len(m)) for i, s in enumerate(sets) if s and i % 3 == 0 for c, m in classes.items() if 100 * len(c & set(s)) >= 60 * len(c | set(s))}
    got = facts.similar_sets(d.where("id % 3 = 0"), d, 60)
    assert {(x.l_id, x.r_id, x.members) for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no row for each token of a set is sorted again


def test_chains_of_many_pairs_share_a_batch(spark):
    anchors = spark.createDataFrame([(p, a, b) for p in range(4) for a, b in ((0, 1), (1, 0), (2, 2), (3, 4), (4, 3))], "pair long, base long, target long")
    made = align.monotone(anchors)
    want = [(p, *x) for p in range(4) for x in align.longest_chain([(0, 1), (1, 0), (2, 2), (3, 4), (4, 3)])]
    assert sorted(map(tuple, made.collect())) == want
    assert "InPandas" not in made._jdf.queryExecution().toString()


def test_comparison_cuts_units_once(spark):
    cut = spark.sparkContext.accumulator(0)

    def seen(text):
        cut.add(1)
        return text

    rows = [(p, i, f"clause {p} says {i * 7} and {i % 3}", None) for p in range(3) for i in range(12)]
    units = spark.createDataFrame(rows, "pair long, ordinal long, text string, clause string")
    said = F.udf(seen, "string")("text")
    compared = compare.compare(units.withColumn("text", said), units.where("ordinal % 5 <> 3").withColumn("text", said))
    found = {r.pair: (r.base_units, r.target_units, r.diffs) for r in compared["diagnostics"].collect()}
    assert found == {p: (12, 10, 2) for p in range(3)}
    assert compared["warnings"].count() and cut.value == 36 + 30
