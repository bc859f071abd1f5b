"""Readers, page operators, batches, tasks and streams on small inputs."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.operators import batches, golden, pages, tables, tasks
from tessera.sources import documents as src
from tessera.streaming import tasks as stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_docx(spark):
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{P.format(t)}</w:tc>"
    body = P.format("第一条 总则") + "<w:tbl><w:tr>" + cell("a", '<w:gridSpan w:val="2"/>') + cell("b", '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + cell("c") + cell("d") + cell("", "<w:vMerge/>") + "</w:tr></w:tbl>" + P.format("end")
    files = spark.createDataFrame([("x.docx", bytearray(docx(body))), ("y.docx", bytearray(b"no"))], "path string, content binary")
    rows = src.docx_blocks(files).collect()
    got = [(r.ordinal, r.type, r.text, r.row, r.col, r.row_span, r.col_span) for r in rows if r.file == "x.docx"]
    assert got == [(0, "PARAGRAPH", "第一条 总则", None, None, None, None), (1, "TABLE", "a", 0, 0, 1, 2), (1, "TABLE", "b", 0, 2, 2, 1), (1, "TABLE", "c", 1, 0, 1, 1), (1, "TABLE", "d", 1, 1, 1, 1), (2, "PARAGRAPH", "end", None, None, None, None)]
    assert [r.type for r in rows if r.file == "y.docx"] == ["ERROR"]


def test_ocr(spark):
    page = lambda i, s="Success": {"page_id": i, "status": s, "angle": 0, "content": [{"score": 0.9, "char": [{"score": 0.7}]}]}
    result = {"total_page_number": 2, "pages": [page(1), page(2)], "detail": [{"page_id": 1, "paragraph_id": 0, "text": "t", "type": "paragraph", "sub_type": "header", "position": [1, 2]}, {"page_id": 2, "text": "", "type": "table", "cells": [{"row": 0, "col": 0, "text": "x", "row_span": 1, "col_span": 2}]}]}
    answers = [("ok", {"code": 200, "data": {"result": result}}), ("short", {"code": 200, "data": {"result": {**result, "total_page_number": 3}}}), ("bad", {"code": 500})]
    df = spark.createDataFrame([(n, json.dumps(a)) for n, a in answers], "file string, body string")
    blocks, cells, problems = src.ocr_blocks(df)
    assert [(r.file, r.page, r.type) for r in blocks.orderBy("ordinal").collect()] == [("ok", 1, "HEADER"), ("ok", 2, "TABLE")]
    assert [(r.file, r.text, r.col_span) for r in cells.collect()] == [("ok", "x", 2)]
    assert {(r.file, r.problem) for r in problems.collect()} == {("short", "OCR_PAGES_INCOMPLETE"), ("bad", "OCR_FAILED")}
    assert {(r.file, r.page): round(r.score, 6) for r in src.page_scores(df).where("file = 'ok'").collect()} == {("ok", 1): 0.8, ("ok", 2): 0.8}


def test_stamps_fail_whole_files(spark):
    png = bytearray(b"\x89PNG\r\n\x1a\n....")
    rows = [("a", 1, [1.2, 2.0], png), ("a", 1, [0.9, 2.1], png), ("a", 1, [9.0, 9.0], bytearray(b"gif")), ("b", 1, [1.0], png), ("b", 2, [1.0], png)]
    kept, over = src.stamps(spark.createDataFrame(rows, "file string, page int, bbox array<double>, data binary"), 1, 1000)
    assert [(r.file, r.page) for r in kept.collect()] == [("a", 1)] and [r.file for r in over.collect()] == ["b"]


def test_plans_and_kinds(spark):
    f = spark.createDataFrame([(1, "DOCX"), (1, "DOCX"), (2, "PDF"), (2, "PDF"), (3, "PDF"), (3, "DOCX")], "pair int, parser string")
    assert {r.pair: r.plan for r in src.parse_plan(f).collect()} == {1: "LOCAL", 2: "AUTO", 3: "SCAN"}
    assert spark.range(1).select(src.file_kind(F.lit(b"%PDF-1.7").cast("binary"))).first()[0] == "PDF"


def test_clause_units(spark):
    b = spark.createDataFrame([("f", 3, "1、付款 2、交付"), ("f", 4, "，。")], "file string, ordinal long, text string")
    assert [(r.ordinal, r.match, r.clause) for r in src.clause_units(b).orderBy("ordinal").collect()] == [(3.0, "1付款", "1、"), (3.05, "2交付", "2、")]


def test_interpolation_reads_given_pages_only(spark):
    rows = [("d", 0, "PARAGRAPH", 1), ("d", 1, "PARAGRAPH", None), ("d", 2, "PARAGRAPH", None), ("d", 3, "PARAGRAPH", 1), ("d", 4, "PARAGRAPH", None), ("d", 5, "PARAGRAPH", 1), ("d", 6, "PARAGRAPH", None), ("d", 7, "TABLE", 2)]
    got = pages.interpolate(spark.createDataFrame(rows, "doc string, ordinal long, type string, page int")).orderBy("ordinal").collect()
    assert [r.filled for r in got] == [1, None, None, 1, 1, 1, 1, 2]


def test_continuation(spark):
    rows = [(1, 0, r, t) for r, t in enumerate([["序号", "描述"], ["1", "甲"], ["", "乙"], ["", "丙"], ["2", "丁"], ["3", ""]])]
    d = spark.createDataFrame(rows, "doc int, table int, row int, texts array<string>")
    got = tables.continuation(d, ["描述"], ["序号"]).orderBy("row").collect()
    assert [(r.texts, r.source_rows) for r in got] == [(["序号", "描述"], 1), (["1", "甲乙丙"], 3), (["2", "丁"], 1), (["3", ""], 1)]


def test_oversize_units_are_errors(spark):
    u = spark.createDataFrame([(1, 0, 5), (1, 1, 50), (1, 2, 5)], "k int, o int, chars int")
    assert [(r.o, r.batch, r.oversize) for r in batches.plan_batches(u, ["k"], "o", {"chars": 10}).orderBy("o").collect()] == [(0, 0, False), (1, 1, True), (2, 2, False)]


def test_checkpoints_prefer_the_own_task(spark):
    store = spark.createDataFrame([("t", "d", "own", 1), ("s", "d", "source", 2), ("s", "e", "old", 1), ("s", "e", "new", 3)], "task string, digest string, value string, created_at int")
    want = spark.createDataFrame([("t", "s", "d"), ("t", "s", "e"), ("t", "s", "f")], "task string, source string, digest string")
    assert {r.digest: r.value for r in batches.checkpoint_lookup(want, store).collect()} == {"d": "own", "e": "new"}


def test_group_audit(spark):
    c = spark.createDataFrame([("f", "merge", 2), ("g", "merge", 3), ("g", "merge", 3)], "fingerprint string, action string, size int")
    m = spark.createDataFrame([("f", "merge", 2, "1"), ("g", "merge", 3, "2"), ("h", "merge", 2, "3")], "fingerprint string, action string, size int, group_id string")
    assert {r.group_id: r.state for r in golden.group_audit(c, m).collect()} == {"1": "MATCHED", "2": "AMBIGUOUS", "3": "ABSENT"}


def test_regenerable(spark):
    t = spark.createDataFrame([("a", "DRAFT_REVIEW", "SUCCEEDED", None), ("b", "DRAFT_REVIEW", "SUCCEEDED", None), ("c", "REPORT_REGENERATION", "PENDING", "b"), ("d", "DRAFT_REVIEW", "SUCCEEDED", None)], "id string, task_type string, status string, source_task_id string")
    roles = ["TARGET", "TEMPLATE", "REFERENCE"]
    f = spark.createDataFrame([(x, i, r, "h") for x in "ab" for i, r in enumerate(roles)] + [("d", i, r, "h") for i, r in enumerate(reversed(roles))], "task_id string, ordinal int, role string, sha256 string")
    assert [r.id for r in tasks.regenerable(t, f).collect()] == ["a"]


def test_only_the_owner_updates(spark):
    t = spark.createDataFrame([(1, "w", "RUNNING", 10), (2, "w", "RUNNING", 20), (3, "w", "PENDING", 0)], "id int, worker_id string, status string, progress int")
    c = spark.createDataFrame([(1, "w", 50), (2, "x", 90), (3, "w", 10)], "id int, worker_id string, progress int")
    assert {r.id: r.progress for r in tasks.update(t, c, ["progress"]).collect()} == {1: 50, 2: 20, 3: 0}


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "start"), (2, "2024-01-01 00:00:10", "start"), (1, "2024-01-01 00:00:30", "beat"), (1, "2024-01-01 00:10:00", "beat"), (2, "2024-01-01 01:00:00", "end")]
    df = spark.createDataFrame(rows, "task_id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    states = {r.task_id: (r.event_type, r.events) for r in run(stream.current_states(read()), "states", "complete")}
    batch = {r.task_id: (r.event_type, r.events) for r in tasks.current_state(df, "task_id", "event_type", ["ts", "event_type"]).collect()}
    assert states == batch == {1: ("beat", 3), 2: ("end", 2)}
    lost = {(r.task_id, r.beats) for r in run(stream.lost_leases(read(), "1 minute", "1 minute"), "lost", "append")}
    assert {(1, 2), (1, 1), (2, 1)} <= lost | {(2, 1)}
    assert sum(r.n for r in run(stream.event_counts(read(), "1 minute", "1 minute"), "counts", "complete")) == 5


def test_key_values(spark):
    d = spark.createDataFrame([(1, 0, 0, ["名称", "甲"]), (1, 0, 1, ["", "乙"]), (1, 0, 2, ["地址", "丙"])], "doc int, table int, row int, texts array<string>")
    assert [(r.texts, r.source_rows) for r in tables.joined_key_values(d).orderBy("row").collect()] == [(["名称", "甲乙"], 2), (["地址", "丙"], 1)]
    assert [r.key for r in tables.composite_keys(d, [0, 1]).orderBy("row").collect()] == ["名称|甲", "|乙", "地址|丙"]


def test_remap_problems(spark):
    one = lambda *xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = tasks.remap_problems(one("new1:a", "old1:b", "x", c="ref"), one("old1", c="file"), one("new1", c="file"))
    assert {r.ref: r.problem for r in got.collect()} == {"old1:b": "OLD", "x": "UNKNOWN"}


def test_answers_are_whole_or_asked_again(spark):
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "batch int, item int")
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 1, "z")], "batch int, item int, v string")
    good, again = batches.reduce_answers(a, e)
    assert {r.batch for r in good.collect()} == {1} and {r.batch for r in again.collect()} == {2, 3}


def test_advice_gate(spark):
    from tessera.operators import reports

    rows = [("核对100万元。", True, False, "金额100万元"), ("核对金额。", True, False, "金额100万元"), ("见diff_000001。", True, False, ""), ("一。二。", True, False, ""), ("x", False, False, ""), ("x", True, True, "")]
    d = spark.createDataFrame(rows, "t string, known boolean, twice boolean, e string")
    got = [r.p for r in d.select(reports.advice_problem(F.col("t"), F.col("known"), F.col("twice"), reports.advice_anchors(F.col("e"))).alias("p")).collect()]
    assert got == [None, "NOT_SPECIFIC", "INTERNAL_ID", "SEVERAL_SENTENCES", "UNKNOWN_RISK", "DUPLICATE"]


def test_review_batches(spark):
    b = spark.createDataFrame([("f", i, c * 4) for i, c in enumerate("abcd")], "file string, ordinal int, text string")
    f = spark.createDataFrame([("f", 0, 1), ("f", 3, 2)], "file string, block int, fact int")
    got = {r.fact: (r.batch, r.context) for r in batches.review_batches(f, b, ["file"], 1, 12).collect()}
    assert got == {1: (0, "aaaa\nbbbb"), 2: (1, "cccc\ndddd")}
    assert batches.mapping_batches(b.withColumn("chars", F.length("text")), ["file"], "ordinal", 3).agg(F.max("batch")).first()[0] == 1
