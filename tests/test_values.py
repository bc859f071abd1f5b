"""Literal cases of values, rules and text scalars."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.functions.values import canonical, normal_form, same_value
from tessera.operators import align, candidates, diffs, facts, graph, pages, reports, rules


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("kind,raw,want", [
    ("MONEY", "1,000万元", "MONEY:1E+7"), ("MONEY", "人民币100元", "MONEY:1E+2:CNY"), ("MONEY", "12.50元", "MONEY:12.5"), ("MONEY", "1200元", "MONEY:1.2E+3"),
    ("PERCENTAGE", "5.20%", "PERCENTAGE:5.2%"), ("RATE", "50BP", "PERCENTAGE:0.5%"), ("DURATION", "2年", "DURATION:24M"), ("DURATION", "3周", "DURATION:21D"),
    ("DATE", "2026年8月21日", "DATE:2026-08-21"), ("DATE", "2026-13-40", "DATE:2026-13-40"), ("NUMBER", "3 Pieces", "NUMBER:3:pieces"), ("TEXT", " 甲 方。", "TEXT:甲方"),
])
def test_canonical(spark, kind, raw, want):
    form = normal_form(F.col("raw"), F.col("kind"))
    assert one(spark, canonical(form, F.col("raw"), F.col("kind")), raw=raw, kind=kind) == want


@pytest.mark.parametrize("kind,a,b,want", [
    ("PERCENTAGE", "0.10%", "0.1%", True), ("MONEY", "1000万元", "2000万元", False), ("MONEY", "1000万元", "10000000元", True), ("MONEY", "人民币100元", "100美元", None),
    ("DURATION", "1年", "365天", None), ("DURATION", "1年", "12个月", True), ("NUMBER", "many", "3", None), ("TEXT", "甲方", "甲 方", True), ("TEXT", "甲方", "乙方", False),
])
def test_three_valued_comparison(spark, kind, a, b, want):
    x, y, k = normal_form(F.col("a"), F.col("k")), normal_form(F.col("b"), F.col("k")), F.col("k")
    assert one(spark, same_value(x, y, k, k, canonical(x, F.col("a"), k), canonical(y, F.col("b"), k)), a=a, b=b, k=kind) is want


def test_text_scalars(spark):
    c = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert c(tx.normalize_text, " Ａ　 b ") == "A b"
    assert c(tx.comparable_text, "甲 方：$**某​公司**$<br/>x，y") == "甲方:某公司 x,y"
    assert c(lambda t: tx.match_text(tx.comparable_text(t)), "第1条 甲方：（某）") == "第1条甲方某"
    assert c(tx.clause_key, "第十二条 违约") == "第十二条"
    assert c(tx.clause_key, "1.2、金额") == "1.2、"
    assert c(tx.clause_key, "金额") is None
    assert c(tx.without_marker, "（一） 付款方式") == "付款方式"
    assert c(tx.clause_pieces, "甲方 1、付款 2、交付") == ["甲方", "1、付款", "2、交付"]
    assert c(tx.value_tokens, "自2026年8月21日起三个月内付1,000.5元") == ["1,000.5", "2026年8月21日", "三个月"]
    assert one(spark, tx.candidate_value(F.col("v"), F.col("k")), v="1,000 万元", k="MONEY") == "1000万元"
    assert one(spark, tx.candidate_value(F.col("v"), F.col("k")), v="5％", k="PERCENTAGE") == "5%"
    assert c(tx.sanitize_url, "https://a.b/c?d=e#f") == "https://a.b/c"
    assert [c(tx.url_allowed, u) for u in ("https://a.b/c", "http://127.0.0.1/x", "ftp://a.b", "https://u@a.b/", "http://10.1.2.3/")] == [True, False, False, False, False]
    assert c(tx.single_sentence, "**请核对。** 再确认！") == "请核对，再确认。"
    assert c(tx.bigrams, "abab") == ["ab", "ba"]


def test_numbers_changed(spark):
    f = tx.numbers_changed(F.col("a"), F.col("b"))
    assert one(spark, f, a="合同金额100万元。", b="合同金额120万元。") is True
    assert one(spark, f, a="合同金额100万元。", b="合同金额。") is False


def test_similarity(spark):
    assert sim.lcs_length("abcbdab", "bdcaba") == 4
    assert sim.indel("", "") == 100 and sim.indel("abc", "") == 0 and sim.indel(None, "a") is None
    assert one(spark, sim.partial_ratio("a", "b"), a="abc", b="xxabcyy") == 100
    assert one(spark, sim.block_similarity("a", "b"), a="abcd", b="ab") == 0.5
    assert sim.segments("金额100元", "金额120元")[:2] == [{"op": "EQUAL", "text": "金额1"}, {"op": "INSERT", "text": "2"}] or any(s["op"] == "DELETE" for s in sim.segments("金额100元", "金额120元"))
    assert sim.segments("a b", "a  b") == [{"op": "EQUAL", "text": "a  b"}]


def test_chain_is_longest_and_earliest():
    assert align.longest_chain([(0, 2), (1, 0), (2, 1), (3, 3)]) == [(1, 0), (2, 1), (3, 3)]
    assert align.longest_chain([]) == []


def test_alignment_pairs_split_paragraphs():
    left, right = [("甲方应当支付货款并且承担运费", None)], [("甲方应当支付货款", None), ("并且承担运费", None)]
    assert [s[:4] for s in align.align_units(left, right)] == [(0, 1, 0, 2)]
    apart = list(align.align_units([("1.保证人承担责任", None)], [("1.今天天气很好", None)]))
    assert sorted(s[1::2][:2] for s in apart) == [(0, 1), (1, 0)]


AST = {"op": "equals", "left": {"op": "multiply", "args": [{"op": "fact", "concept_id": "unit"}, {"op": "literal", "value": "2"}]}, "right": {"op": "fact", "concept_id": "total"}, "tolerance": "0.01"}


@pytest.mark.parametrize("values,status,reason", [
    ({"unit": ["1000000"], "total": ["2000000"]}, "PASSED", None), ({"unit": ["1000000"], "total": ["2000001"]}, "FAILED", "NUMERIC_RULE_FAILED"),
    ({"unit": ["1", "2"], "total": ["2"]}, "REVIEW_REQUIRED", "NUMERIC_RULE_AMBIGUOUS_INPUT"), ({"unit": ["1"]}, "REVIEW_REQUIRED", "NUMERIC_RULE_UNCERTAIN"),
])
def test_rules(spark, values, status, reason):
    rows = [("r", n, "f", v) for n, vs in values.items() for v in vs]
    f = spark.createDataFrame(rows, "review string, name string, file string, value string").withColumn("value", F.col("value").cast("decimal(38,10)"))
    r = rules.verdicts(f, [{"validation_id": "v", "expression": AST}]).first()
    assert (r.status, r.reason) == (status, reason)


def deep(n):
    node = {"op": "literal", "value": "1"}
    for _ in range(n):
        node = {"op": "add", "args": [node, {"op": "literal", "value": "1"}]}
    return {"op": "equals", "left": node, "right": {"op": "literal", "value": "1"}}


@pytest.mark.parametrize("node", [{"op": "execute"}, deep(7), {"op": "literal", "value": "1"}, {**AST, "tolerance": "-1"}, {"op": "less_than", "left": {"op": "literal", "value": 1}, "right": {"op": "literal", "value": "1"}}, {**AST, "x": 1}])
def test_unsafe_rules(node):
    with pytest.raises(rules.RuleError):
        rules.check(node)


def test_cliques():
    edges = {(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4), (3, 5), (4, 5)}
    assert graph.pack_cliques(list(range(6)), edges, 3) == [(0, 1, 2), (3, 4, 5)]
    many = {(i, i + 1) for i in range(29)}
    assert len(graph.pack_cliques(list(range(30)), many, 3)) == 15


def test_fills(spark):
    f = reports.allowed_fill(F.col("a"), F.col("b"))
    assert one(spark, f, a="金额##{融资金额}万元(含税)", b="金额1000万元(含税)") is True
    assert one(spark, f, a="金额##{融资金额}万元", b="金额1000元") is False
    assert one(spark, f, a="金额万元", b="金额万元") is False


def test_merging_differences(spark):
    d = spark.createDataFrame([(1, 1, "DELETED", 1, "a"), (1, 2, "DELETED", 2, "b"), (1, 3, "DELETED", 3, "c"), (1, 4, "ADDED", 4, "付款期限为十天"), (1, 5, "DELETED", 9, "付款期限为九天")], "pair long, ordinal long, kind string, paragraph long, text string")
    assert [(r.ordinal, r.n, r.text) for r in diffs.merge_deletions(d).orderBy("ordinal").collect()] == [(1, 2, "a\nb"), (3, 1, "c"), (5, 1, "付款期限为九天")]
    got = {(r.ordinal, r.kind, r.before, r.after) for r in diffs.recompose(d).collect()}
    assert (4, "MODIFIED", "付款期限为九天", "付款期限为十天") in got and len(got) == 4


def test_deoverlap(spark):
    s = spark.createDataFrame([(1, 0, 5, 10), (1, 3, 8, 100), (1, 4, 9, 10), (1, 20, 22, 1)], "k long, first long, last long, priority long")
    assert sorted((r.first, r.last) for r in diffs.deoverlap(s, ["k"]).collect()) == [(0, 5), (3, 8), (20, 22)]


def test_required_missing(spark):
    t = facts.with_forms(spark.createDataFrame([(1, "amount", "MONEY", "100元")], "fact long, field string, kind string, raw string"))
    r = facts.with_forms(spark.createDataFrame([(2, "a", "amount", "MONEY", "200元")], "fact long, file string, field string, kind string, raw string"))
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    need = spark.createDataFrame([(1, "b")], "fact long, file string")
    items = facts.matrix_items(facts.fact_matrix(t, r, facts.default_mapping(t, r), files, need))
    assert {(x.kind, x.code, x.file) for x in items.collect()} == {("RISK", "SOURCE_CONFLICT", "a"), ("RISK", "REQUIRED_SOURCE_MISSING", "b")}


def test_typed_spans(spark):
    text = "合同编号：AB-2026/01，金额1,000万元，费率5.20%，期限2年，签于2026年8月21日，第3条，共12台，另付租金35，见7。"
    b = spark.createDataFrame([(1, "PARAGRAPH", text)], "doc int, type string, text string")
    found = candidates.spans(b, ["doc"])
    chosen = candidates.numeric_candidates(found, ["doc"])
    got = {(r.kind, r.raw) for r in chosen.collect()}
    assert {("IDENTIFIER", "AB-2026/01"), ("MONEY", "1,000万元"), ("PERCENTAGE", "5.20%"), ("DURATION", "2年"), ("DATE", "2026年8月21日"), ("QUANTITY", "12台"), ("NUMBER", "35")} <= got
    assert not any(r == "3" for _, r in got)
    m = candidates.metrics(found, chosen).first()
    assert m.total == m.structural + m.overlapping + m.chosen
    values = {r.value for r in candidates.cross_candidates(chosen, b, ["doc"]).collect()}
    assert {"1000万元", "5.20%", "2026年8月21日"} <= values
    assert candidates.text_candidates(b).count() == 1


@pytest.mark.parametrize("text,want", [("十二", 12), ("三百零五", 305), ("两千", 2000), ("一万二千", 12000), ("37", 37), ("甲", None), ("", None), ("二十", 20)])
def test_chinese_numbers(spark, text, want):
    assert one(spark, candidates.chinese_number(F.col("t")), t=text) == want


def test_grounded_quotes(spark):
    f = candidates.grounded_quote("s", "q")
    assert one(spark, f, s="金额 １００ 万元整", q="100万元") == "１００ 万元"
    assert one(spark, f, s="abab", q="ab") is None
    assert one(spark, f, s="abc", q="x") is None


def test_page_spans_are_unique_and_monotone():
    local = ["第一段内容很长很长很长", "第二段内容也很长很长", "相同", "相同"]
    external = ["第一段内容很长", "很长很长", "第二段内容也很长很长", "相同"]
    assert pages.align_spans(local, external)[:2] == [(0, 0, 2), (1, 2, 3)]
    assert pages.align_spans(["相同"], ["相同", "相同"]) == []


def test_find_paragraph(spark):
    b = spark.createDataFrame([(1, 0, 1, "甲方付款"), (1, 1, 2, "甲方付款"), (1, 2, 2, "乙方应当在十日内交货")], "doc int, ordinal int, page int, text string")
    s = spark.createDataFrame([("a", 1, 2, "甲方付款"), ("b", 1, 9, "甲方付款"), ("c", 1, 1, "乙方应当在九日内交货"), ("d", 1, 1, "无关")], "side string, doc int, page int, text string")
    assert {r.side: (r.ordinal, r.how) for r in candidates.find_paragraph(s, b).collect()} == {"a": (1, "PAGE"), "b": (0, "EQUAL"), "c": (2, "SIMILAR")}


def test_composition(spark):
    import unicodedata

    from tessera.functions.text import nfkc

    texts = ["plain", "é", "e\u0301", "ｆｕｌｌ，", "½ ² ª", "ﬁ", "中文。", "각", None, "", "Å", "a\u0327\u0301", "ĳ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", nfkc(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
