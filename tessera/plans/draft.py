"""Reviewing a draft against its template and other files: template analysis and the published result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import reports, tables
from tessera.plans import compare

# What is still open in a finished text.
OPEN = {"UNRESOLVED_PLACEHOLDER": r"##\{.*?\}", "UNFILLED_BLANK": r"_{2,}"}


def template_analysis(template: DataFrame, target: DataFrame, template_cells: DataFrame, target_cells: DataFrame) -> dict[str, DataFrame]:
    """What a target changes in its template, apart from what the template leaves open.

    retained and allowed: differences of the two; open: placeholders and blanks left in the target; blanks: table cells that the template
    asks for and the target lacks; diagnostics and warnings of the comparison. template, target: units (pair, ordinal, text, clause); cells
    as in ``tables``, their document being the pair.
    """
    compared = compare.compare(template, target)
    filled = F.coalesce(reports.allowed_fill(F.col("before"), F.col("after")), F.lit(False))
    marked = compared["diffs"].withColumn("allowed", filled)
    left = reports.unresolved(target.select(F.col("pair").alias("doc"), F.col("ordinal").alias("place"), "text"), OPEN)
    blanks = tables.required_blanks(template_cells, target_cells).withColumnRenamed("doc", "pair")
    return {
        "retained": marked.where("not allowed").drop("allowed"), "allowed": marked.where("allowed").drop("allowed"),
        "open": left.withColumnRenamed("doc", "pair"), "blanks": blanks, "diagnostics": compared["diagnostics"], "warnings": compared["warnings"],
    }


def template_items(analysis: dict[str, DataFrame]) -> DataFrame:
    """(review, kind, code, ref): retained changes, open places and missing cells are risks; of pairs that can't be relied on a review asks for all."""
    item = lambda d, kind, code, ref: d.select(F.col("pair").alias("review"), F.lit(kind).alias("kind"), code.alias("code"), ref.cast("string").alias("ref"))
    changed = item(analysis["retained"], "RISK", F.concat(F.lit("TEMPLATE_"), F.col("kind")), F.col("diff_id"))
    open_ = item(analysis["open"], "RISK", F.col("rule"), F.col("place"))
    blank = item(analysis["blanks"], "RISK", F.lit("REQUIRED_CELL_EMPTY"), F.concat_ws("/", "table", "row", "col"))
    unsure = item(analysis["diagnostics"].where("not reliable"), "REVIEW", F.lit("TEMPLATE_ALIGNMENT_UNRELIABLE"), F.lit(None))
    return changed.unionByName(open_).unionByName(blank).unionByName(unsure)


def rule_items(verdicts: DataFrame, review: str = "review") -> DataFrame:
    """Verdicts on numeric rules as items: FAILED is a risk, REVIEW_REQUIRED a review, PASSED a passed check."""
    kind = F.when(F.col("status") == "FAILED", "RISK").when(F.col("status") == "REVIEW_REQUIRED", "REVIEW").otherwise("PASSED")
    return verdicts.select(F.col(review).alias("review"), kind.alias("kind"), F.coalesce("reason", F.lit("NUMERIC_RULE_PASSED")).alias("code"), F.col("validation_id").alias("ref"))


def fact_items(items: DataFrame, review: Column) -> DataFrame:
    """The items of a fact matrix, each with its review; an item is named by its fact and file."""
    return items.select(review.alias("review"), "kind", "code", F.concat_ws("@", F.col("fact").cast("string"), "file").alias("ref"))


def consensus(items: DataFrame, votes: DataFrame, least: int = 2) -> DataFrame:
    """items with those as REVIEW that fewer than ``least`` reviews of a model confirmed; items that no model was asked about stay. votes: (review, code, ref, confirmed)."""
    asked = votes.groupBy("review", "code", "ref").agg(F.count_if("confirmed").alias("_yes"))
    met = items.join(asked.withColumnRenamed("ref", "_ref"), [items["review"] == asked["review"], items["code"] == asked["code"], items["ref"].eqNullSafe(F.col("_ref"))], "left")
    kind = F.when((items["kind"] == "RISK") & (F.col("_yes") < least), "REVIEW").otherwise(items["kind"])
    return met.select(items["review"], kind.alias("kind"), items["code"], items["ref"])


def result(reviews: DataFrame, items: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """One row for each review: conclusion, counts and its items by kind, equal ones once, in order.

    conflicts: (review, ref) definitions that contradict each other: rules that name them are reviews, never passed or failed.
    """
    every = items.distinct()
    if conflicts is not None:
        clash = conflicts.select("review", "ref", F.lit(True).alias("_clash")).distinct()
        met = every.join(clash, ["review", "ref"], "left")
        every = met.select("review", F.when(F.col("_clash"), "REVIEW").otherwise(F.col("kind")).alias("kind"), F.when(F.col("_clash"), "SPECIFICATION_CONFLICT").otherwise(F.col("code")).alias("code"), "ref").distinct()
    entry = F.struct("code", "ref")
    listed = every.groupBy("review").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(to) for k, to in (("RISK", "risk_items"), ("REVIEW", "review_items"), ("PASSED", "passed_checks"))])
    rows = reviews.select("review").distinct().join(listed, "review", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    conclusion = F.when(size("risk_items") > 0, "RISK_FOUND").when(size("review_items") > 0, "REVIEW_REQUIRED").otherwise("PASS")
    return rows.withColumns({"risk_count": size("risk_items"), "review_count": size("review_items"), "passed_count": size("passed_checks"), "conclusion": conclusion})
