"""Units that values are read from: paragraphs, table rows and parts of them, and what is read put back in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text, number_tokens
from tessera.operators._kept import kept
from tessera.operators.batches import plan_batches
from tessera.operators.candidates import grounded_quote

# Where a sentence and where a clause ends.
SENTENCE_ENDS, CLAUSE_ENDS = "。！？；!?;\n\r", "，,、"


def extraction_units(paragraphs: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """(doc, ordinal, row, part, text, oversize): a unit for each paragraph and each table row, in the order of the document.

    A row of over ``most`` characters (its cells joined by tabs) is cut between cells, each part as full as it can be;
    a single cell beyond that is marked oversize. paragraphs: (doc, ordinal, text); cells: (doc, ordinal, row, col, text).
    """
    tab = F.length("text") + 1
    parted = plan_batches(cells.withColumn("chars", tab), ["doc", "ordinal", "row"], "col", {"chars": most + 1})
    inner = F.array_sort(F.collect_list(F.struct("col", "text")))
    rows = parted.groupBy("doc", "ordinal", "row", F.col("batch").alias("part")).agg(F.array_join(F.transform(inner, lambda c: c["text"]), "\t").alias("text"), F.bool_or("oversize").alias("oversize"))
    whole = paragraphs.select("doc", "ordinal", F.lit(0).alias("row"), F.lit(0).alias("part"), "text", F.lit(False).alias("oversize"))
    return whole.unionByName(rows.select("doc", "ordinal", "row", "part", "text", "oversize"))


def _cut_after(text: Column, marks: str) -> Column:
    """The parts that end after one of the marks, trimmed and not blank; none if there is only one."""
    parts = F.filter(F.transform(F.split(text, f"(?<=[{marks}])"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def pieces(text: Column) -> Column:
    """The sentences of a text, else its clauses, else its halves at the gap nearest the middle; none if no cut keeps its numbers whole."""
    n = F.length(text)
    middle = F.floor(n / 2).cast("int")
    gaps = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)).rlike(f"(?U)[\\s{CLAUSE_ENDS}]"))
    nearest = F.array_min(F.transform(gaps, lambda i: F.struct(F.abs(i - middle).alias("off"), i.alias("at"))))["at"]
    at = F.greatest(F.lit(1), F.least(F.coalesce(nearest, middle), n - 1))
    in_number = F.substring(text, at, F.lit(2)).rlike(r"^(?U)\d\d$")
    # a gap isn't within a number; without one a number in the middle stays whole
    at = F.when(~in_number, at).otherwise(nearest)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    halves = F.array(strip(F.substring(text, F.lit(1), at)), strip(F.substring(text, at + 1, n)))
    split = F.when((F.length(strip(text)) >= 2) & at.isNotNull() & ~F.array_contains(halves, ""), halves).otherwise(F.array().cast("array<string>"))
    sentences, clauses = _cut_after(text, SENTENCE_ENDS), _cut_after(text, CLAUSE_ENDS)
    return F.when(F.size(sentences) > 1, sentences).when(F.size(clauses) > 1, clauses).otherwise(split)


def numeric_units(units: DataFrame, most: int) -> DataFrame:
    """units (key columns, path, text) cut until each has ``most`` numbers at most; those that no cut helps are marked too_large.

    path: array of int, the way of cuts that led to a unit.
    """
    keys = [c for c in units.columns if c not in ("path", "text")]
    done, open_ = None, units
    while True:
        counted = open_.withColumn("_n", F.size(number_tokens(F.col("text")))).withColumn("_p", F.when(F.col("_n") > most, pieces(F.col("text"))))
        ready = counted.where((F.col("_n") <= most) | (F.size("_p") == 0)).select(*keys, "path", "text", (F.col("_n") > most).alias("too_large"))
        done = ready if done is None else done.unionByName(ready)
        open_ = kept(counted.where((F.col("_n") > most) & (F.size("_p") > 0)).select(*keys, "path", F.posexplode("_p").alias("_i", "text")).select(*keys, F.concat("path", F.array("_i")).alias("path"), "text"))
        if open_.isEmpty():
            return done


def template_candidates(diffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, place, text, diff_ids): what the target has beyond its template, once for each place and text, with all differences that say so.

    diffs: (doc, diff_id, kind, place, after, inserts): deletions have no text in the target; of others the inserted parts count, else the whole
    text; both must stand in the block of their place, once. blocks: (doc, place, text).
    """
    found = diffs.where((F.col("kind") != "DELETED") & F.col("after").isNotNull()).join(blocks.select("doc", "place", F.col("text").alias("_b")), ["doc", "place"])
    parts = found.select("doc", "place", "diff_id", "after", "_b", F.posexplode_outer(F.filter("inserts", lambda t: F.trim(t) != "")).alias("_i", "_s")).withColumn("_g", grounded_quote("_b", "_s"))
    grounded = parts.where("_g is not null").select("doc", "place", "diff_id", F.col("_g").alias("text"))
    rest = found.join(grounded.select("doc", "place", "diff_id").distinct(), ["doc", "place", "diff_id"], "left_anti").withColumn("text", grounded_quote("_b", "after")).where("text is not null").select("doc", "place", "diff_id", "text")
    every = grounded.unionByName(rest).withColumn("_k", normalize_text(F.col("text")))
    return every.groupBy("doc", "place", "_k").agg(F.min_by("text", "diff_id").alias("text"), F.array_sort(F.collect_set("diff_id")).alias("diff_ids")).drop("_k")


def rehydrated(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """facts (doc, place, raw, evidence) with both as the block of their place has them; error is FACT_VALUE_NOT_GROUNDED where the value doesn't stand there once. Evidence that doesn't is the value."""
    met = facts.join(blocks.select("doc", "place", F.col("text").alias("_b")), ["doc", "place"], "left")
    found = met.withColumns({"_r": grounded_quote("_b", "raw"), "_e": grounded_quote("_b", "evidence")})
    rest = [c for c in facts.columns if c not in ("raw", "evidence")]
    return found.select(*rest, F.coalesce("_r", "raw").alias("raw"), F.coalesce("_e", "_r").alias("evidence"), F.when(F.col("_r").isNull(), "FACT_VALUE_NOT_GROUNDED").alias("error"))
