"""Documents as rows: lines and clause units of texts, DOCX bodies, text pages and OCR answers.

Readers take a DataFrame of whole files (`spark.read.format("binaryFile")`) or of texts and return
one row for each block, keyed by file and ordinal, so that order is data.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clause_key, clause_pieces, comparable_text, match_text

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "file string, ordinal long, type string, text string, table_index int, row int, col int, row_span int, col_span int, logical string"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, line): the lines of each text that aren't blank; ordinals count all lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("ordinal", "line")).where(F.trim("line") != "").withColumn("ordinal", F.col("ordinal").cast("long"))


def clause_units(blocks: DataFrame, key: str = "file") -> DataFrame:
    """(key, ordinal, text, match, clause): paragraphs cut at clause markers; the i-th of n pieces has ordinal block + i / n / 10; pieces without match text go."""
    pieces = blocks.select(key, "ordinal", clause_pieces(comparable_text(F.col("text"))).alias("p"))
    cut = pieces.select(key, "ordinal", F.size("p").alias("n"), F.posexplode("p").alias("i", "text"))
    units = cut.select(key, (F.col("ordinal") + F.when(F.col("n") > 1, F.col("i") / F.col("n") / 10).otherwise(0.0)).alias("ordinal"), "text", match_text(F.col("text")).alias("match"), clause_key(F.col("text")).alias("clause"))
    return units.where("match <> ''")


def comparable_blocks(blocks: DataFrame, headers: bool = False, structured: Column | None = None) -> DataFrame:
    """The blocks that are compared: paragraphs, tables that aren't structured, and headers, footers and side bars if asked for."""
    kinds = ["PARAGRAPH", "TABLE", *(["HEADER", "FOOTER", "SIDEBAR"] if headers else [])]
    kept = blocks.where(F.col("type").isin(kinds))
    return kept if structured is None else kept.where((F.col("type") != "TABLE") | ~structured)


def parse_docx(raw: bytes) -> list[dict]:
    """Blocks of a DOCX body in order; a merged cell is reported once with its spans."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    blank = {"table_index": None, "row": None, "col": None, "row_span": None, "col_span": None, "logical": None}
    out: list[dict] = []
    tables = 0
    for order, e in enumerate(body if body is not None else ()):
        if e.tag == f"{W}p":
            out.append(blank | {"ordinal": order, "type": "PARAGRAPH", "text": said(e)})
        elif e.tag == f"{W}tbl":
            open_: dict[int, dict] = {}
            for r, row in enumerate(e.findall(f"{W}tr")):
                col = 0
                for cell in row.findall(f"{W}tc"):
                    span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
                    wide = int(span.get(f"{W}val", 1)) if span is not None else 1
                    if merge is not None and merge.get(f"{W}val") != "restart" and col in open_:
                        open_[col]["row_span"] = r - open_[col]["row"] + 1
                    else:
                        made = {"ordinal": order, "type": "TABLE", "text": "\n".join(said(p) for p in cell.findall(f"{W}p")), "table_index": tables, "row": r, "col": col, "row_span": 1, "col_span": wide, "logical": f"{tables}:{r}:{col}"}
                        out.append(made)
                        open_.pop(col, None)
                        if merge is not None:
                            open_[col] = made
                    col += wide
            tables += 1
    return out


def docx_blocks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Blocks of DOCX files; a file that can't be read has one row of type ERROR."""
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("type", pa.string()), ("text", pa.string()), *((n, pa.int32()) for n in ("table_index", "row", "col", "row_span", "col_span")), ("logical", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b[path].to_pylist(), b[content], strict=True):
                try:
                    rows = parse_docx(c.as_py() or b"")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [{"ordinal": 0, "type": "ERROR", "text": type(e).__name__}]
                yield pa.RecordBatch.from_pylist([{"file": p, **r} for r in rows], schema=schema)

    return files.select(path, content).mapInArrow(run, BLOCKS)


def text_pages(pages: DataFrame, least: int = 1) -> DataFrame:
    """(file, ordinal, page, text): one block for each line of text pages (file, page, text); files with fewer than ``least`` characters a page go."""
    enough = pages.groupBy("file").agg(F.sum(F.length(F.trim("text"))).alias("chars"), F.countDistinct("page").alias("n")).where(F.col("chars") >= F.col("n") * least).select("file")
    split = pages.join(enough, "file", "left_semi").select("file", "page", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "")
    return split.select("file", F.shiftleft(F.col("page").cast("long"), 32).bitwiseOR(F.col("line").cast("long")).alias("ordinal"), "page", "text")


def parser_of(mime: Column) -> Column:
    """Which parser reads a media type."""
    return F.when(mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "DOCX").when(mime == "application/pdf", "PDF").otherwise("UNSUPPORTED")


def parse_plan(files: DataFrame) -> DataFrame:
    """(pair, plan): DOCX pairs are read locally, PDF pairs by automatic OCR, mixed pairs by scanning."""
    f = files.groupBy("pair").agg(F.bool_and(F.col("parser") == "DOCX").alias("d"), F.bool_and(F.col("parser") == "PDF").alias("p"))
    return f.select("pair", F.when(F.col("d"), "LOCAL").when(F.col("p"), "AUTO").otherwise("SCAN").alias("plan"))


OCR = "STRUCT<code:INT,msg:STRING,data:STRUCT<result:STRUCT<total_page_number:INT,valid_page_number:INT,success_count:INT,pages:ARRAY<STRUCT<page_id:INT,status:STRING,angle:INT,content:STRING>>,detail:ARRAY<STRUCT<page_id:INT,paragraph_id:INT,outline_level:INT,text:STRING,type:STRING,sub_type:STRING,content:INT,position:ARRAY<INT>,cells:ARRAY<STRUCT<row:INT,col:INT,row_span:INT,col_span:INT,text:STRING,position:ARRAY<INT>>>>>>>>"


def ocr_blocks(answers: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, table cells and problems of OCR answers (file, body as JSON text).

    Incomplete answers (an error code, missing or repeated pages) give a problem row and no blocks.
    """
    r = answers.select("file", F.from_json(body, OCR).alias("j")).select("file", "j.code", F.col("j.data.result").alias("r"))
    pages = F.transform("r.pages", lambda p: p["page_id"])
    problem = (
        F.when(F.col("r").isNull() | (F.col("code") != 200), "OCR_FAILED")
        .when((F.col("r.total_page_number") != F.size(pages)) | (F.size(F.array_distinct(pages)) != F.size(pages)), "OCR_PAGES_INCOMPLETE")
        .when(F.exists("r.pages", lambda p: F.lower(p["status"]) != "success"), "OCR_PAGE_FAILED")
    )
    judged = r.withColumn("problem", problem)
    d = judged.where("problem is null").select("file", F.posexplode("r.detail").alias("ordinal", "d"))
    sub = F.lower(F.coalesce("d.sub_type", F.lit("")))
    kind = F.when(F.col("d.type") == "table", "TABLE").when(sub == "header", "HEADER").when(sub == "footer", "FOOTER").when(sub == "sidebar", "SIDEBAR").otherwise("PARAGRAPH")
    blocks = d.select("file", F.col("ordinal").cast("long").alias("ordinal"), F.col("d.page_id").alias("page"), kind.alias("type"), F.col("d.text").alias("text"), F.col("d.position").alias("bbox"))
    cells = d.where("d.type = 'table'").select("file", "ordinal", F.col("d.page_id").alias("page"), F.explode("d.cells").alias("c")).select("file", "ordinal", "page", "c.*")
    return blocks, cells, judged.where("problem is not null").select("file", "problem")


def page_scores(answers: DataFrame, body: str = "body") -> DataFrame:
    """(file, page, score): mean of every score in each page's content, however deep it stands."""
    p = answers.select("file", F.posexplode(F.from_json(F.get_json_object(body, "$.data.result.pages"), "array<string>")).alias("i", "page"))
    scores = F.transform(F.regexp_extract_all("page", F.lit(r'"score"\s*:\s*([0-9.eE+-]+)'), F.lit(1)), lambda s: s.try_cast("double"))
    s = p.select("file", F.get_json_object("page", "$.page_id").cast("int").alias("page"), F.explode(scores).alias("s"))
    return s.where("s is not null").groupBy("file", "page").agg(F.avg("s").alias("score"))


def stamps(images: DataFrame, most: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(distinct stamp images of each page and rounded box, files over a limit): images (file, page, bbox, data); nothing is cut to fit."""
    box = F.transform("bbox", lambda v: F.round(v))
    kind = F.when(F.substring("data", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "PNG").when(F.substring("data", 1, 3) == F.unhex(F.lit("FFD8FF")), "JPEG")
    once = images.withColumns({"box": box, "kind": kind}).where("kind is not null").groupBy("file", "page", "box").agg(F.min("data").alias("data"), F.min("kind").alias("kind"))
    over = once.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes")).where((F.col("n") > most) | (F.col("bytes") > most_bytes))
    return once.join(over, "file", "left_anti"), over


def file_kind(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    return F.when(F.substring(content, 1, 4) == F.unhex(F.lit("25504446")), "PDF").when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "ZIP").otherwise("UNKNOWN")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation set: one row for each candidate."""
    return spark.read.json(path, multiLine=True).select("target_sha256", "template_sha256", F.explode("candidates").alias("c")).select("target_sha256", "template_sha256", "c.*")
