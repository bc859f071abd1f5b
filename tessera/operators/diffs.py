"""Differences between two versions: classification, runs of missing text, merging and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import at_least
from tessera.functions.text import numbers_changed

# Fixed value: of several findings for one place, the first kind here stays.
PRIORITY = ("NUMERIC_CHANGED", "TABLE_CELL_CHANGED", "MODIFIED", "DELETED", "ADDED", "CONTENT_BLOCK_MISSING", "STRUCTURE_CHANGED")
PLACEHOLDERS = "金额|价款|大写|小写|人民币|____"
#: Rows of a range of ordered rows, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500_000, 1024


def priority(kind: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for i, p in enumerate(PRIORITY):
        out = F.when(kind == p, i).otherwise(out)
    return out


def classify(before: Column, after: Column) -> Column:
    """ADDED, DELETED, NUMERIC_CHANGED or MODIFIED; null for equal texts."""
    return F.when(before.isNull(), "ADDED").when(after.isNull(), "DELETED").when(before == after, None).when(numbers_changed(before, after), "NUMERIC_CHANGED").otherwise("MODIFIED")


def review_reason(before: Column, after: Column, confidence: Column, threshold: float = 0.8) -> Column:
    """Why a difference may be a reading error: placeholder, order, one character or low confidence; else null."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    numeric = numbers_changed(before, after)
    return (
        F.when(numeric, None)
        .when(before.rlike(PLACEHOLDERS) & after.rlike(PLACEHOLDERS), "OCR_PLACEHOLDER_VARIANCE")
        .when(letters(before) == letters(after), "OCR_READING_ORDER_VARIANCE")
        .when((F.greatest(F.length(before), F.length(after)) <= 64) & (F.levenshtein(before, after) == 1) & (confidence < 1), "OCR_SINGLE_CHARACTER_VARIANCE")
        .when(confidence < threshold, "OCR_LOW_CONFIDENCE_VARIANCE")
    )


def islands(rows: DataFrame, keys: list[str], order: str, step: int = 1, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """rows with run: the number of the run of places no more than ``step`` apart, within the keys.

    One key may hold most rows, so they are cut into ranges of the order at quantiles; a range takes over where the one before it ends.
    """
    ranges = min(MOST_RANGES, -(-rows.count() // rows_per_range))
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", at)
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    named = [f"_k{i}" for i in range(len(keys))]
    of_range = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]

    def with_range(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the columns of the one row that right has for its key and range."""
        met = F.col("_range") == F.col("_r")
        for k, n in zip(keys, named, strict=True):
            met = met & F.col(k).eqNullSafe(F.col(n))
        return left.join(right, met).drop("_r", *named)

    # one row for each key and range: where the ranges before it end
    before = F.lag("_last").over(Window.partitionBy(*named).orderBy("_r"))
    ends = ranged.groupBy(*of_range, F.col("_range").alias("_r")).agg(F.max(order).alias("_last")).withColumn("_before", before).drop("_last")
    joined = with_range(ranged, ends)
    begins = F.when(F.col(order) - F.coalesce(F.lag(order).over(inside), "_before") <= step, 0).otherwise(1)
    numbered = joined.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(inside))
    base = F.sum("_n").over(Window.partitionBy(*named).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sums = numbered.groupBy(*of_range, F.col("_range").alias("_r")).agg(F.sum("_b").alias("_n")).withColumn("_base", base).drop("_n")
    return with_range(numbered, sums).select(*rows.columns, (F.col("_run") + F.coalesce("_base", F.lit(0))).alias("run"))


def missing_ranges(unmatched: DataFrame, keys: list[str], order: str = "ordinal", size: str = "chars") -> DataFrame:
    """One row for each run of unmatched places: first, last, units and characters."""
    return islands(unmatched, keys, order).groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("units"), F.sum(size).alias("chars"))


def missing_kind(ranges: DataFrame, page_chars: str = "page_chars", least_pages: float = 0.8, least_units: int = 2) -> DataFrame:
    """ranges (first, last, units, chars, last_unit, whole_page) with kind, certainty and boundary."""
    pages = F.try_divide("chars", page_chars)
    whole = F.col("whole_page")
    page = whole | ((pages >= least_pages) & (F.col("units") >= least_units))
    return ranges.withColumns({
        "pages": pages,
        "kind": F.when(page, "PAGE_MISSING").otherwise("CONTENT_BLOCK_MISSING"),
        "certainty": F.when(whole | ~page, "CONFIRMED").otherwise("INFERRED"),
        "boundary": F.when(F.col("first") == 0, "START").when(F.col("last") == F.col("last_unit"), "END").otherwise("MIDDLE"),
    })


def interval_union(spans: DataFrame, keys: list[str], first: str = "first", last: str = "last", slack: int = 1) -> DataFrame:
    """Maximal intervals of spans that overlap or are no more than ``slack`` apart, with how many each joins."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_b", F.when(F.col(first) <= before + slack, 0).otherwise(1)).withColumn("run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count(F.lit(1)).alias("spans")).drop("run")


def merge_deletions(diffs: DataFrame) -> DataFrame:
    """Runs of deletions whose paragraph is at most one past the run's first paragraph become one row.

    diffs: pair, ordinal, kind, paragraph, text. The gap is measured from the first paragraph of the run, so the
    runs are folded in order, each pair's deletions as one array in the JVM.
    """
    item = F.struct("ordinal", "paragraph", "text")
    listed = diffs.where("kind = 'DELETED'").groupBy("pair").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.expr("cast(array() as array<struct<ordinal:bigint,paragraph:bigint,text:string,n:int>>)")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce((x["paragraph"] - last["paragraph"]).between(0, 1), F.lit(False))
        joined = F.struct(last["ordinal"].alias("ordinal"), last["paragraph"].alias("paragraph"), F.concat_ws("\n", last["text"], x["text"]).alias("text"), (last["n"] + 1).alias("n"))
        alone = F.struct(x["ordinal"].cast("bigint").alias("ordinal"), x["paragraph"].cast("bigint").alias("paragraph"), x["text"].alias("text"), F.lit(1).alias("n"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(alone)))

    return listed.select("pair", F.explode(F.aggregate("items", empty, step)).alias("m")).select("pair", "m.*")


def recompose(diffs: DataFrame, least: float = 72) -> DataFrame:
    """Neighbouring DELETED and ADDED rows with alike texts become one MODIFIED row; pairs are taken from left to right.

    diffs: pair, ordinal, kind, text. A row that could pair with either neighbour pairs with the earlier: in each
    chain of candidates every other link counts.
    """
    w = Window.partitionBy("pair").orderBy("ordinal")
    ahead = diffs.withColumns({"next_kind": F.lead("kind").over(w), "next_text": F.lead("text").over(w), "next_ordinal": F.lead("ordinal").over(w), "place": F.row_number().over(w)})
    opposite = ((F.col("kind") == "DELETED") & (F.col("next_kind") == "ADDED")) | ((F.col("kind") == "ADDED") & (F.col("next_kind") == "DELETED"))
    candidate = ahead.withColumn("link", F.coalesce(opposite & at_least(F.col("text"), F.col("next_text"), least), F.lit(False)))
    chained = islands(candidate.where("link"), ["pair"], "place").withColumn("nth", F.row_number().over(Window.partitionBy("pair", "run").orderBy("place")))
    taken = chained.where("nth % 2 = 1")
    merged = taken.select("pair", "ordinal", F.lit("MODIFIED").alias("kind"), F.when(F.col("kind") == "DELETED", F.col("text")).otherwise(F.col("next_text")).alias("before"), F.when(F.col("kind") == "DELETED", F.col("next_text")).otherwise(F.col("text")).alias("after"))
    used = taken.select("pair", F.explode(F.array("ordinal", "next_ordinal")).alias("ordinal"))
    rest = diffs.join(used, ["pair", "ordinal"], "left_anti").select("pair", "ordinal", "kind", F.when(F.col("kind") == "DELETED", F.col("text")).alias("before"), F.when(F.col("kind") == "ADDED", F.col("text")).alias("after"))
    return merged.unionByName(rest)


def dedup_merge(diffs: DataFrame, keys: list[str], order: str = "ordinal", kind: str = "kind", places: str = "places") -> DataFrame:
    """One row for each key: that of the first kind by priority, then order; places of all, and how many it replaced."""
    rest = [c for c in diffs.columns if c not in (*keys, places)]
    rank = F.struct(priority(F.col(kind)).alias("p"), F.col(order).alias("o"), *[F.col(c) for c in rest])
    grouped = diffs.groupBy(*keys).agg(F.min(rank).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(places)))).alias(places), (F.count(F.lit(1)) - 1).alias("replaced"))
    return grouped.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest], places, "replaced")


def dedup_audit(diffs: DataFrame, keys: list[str], order: str = "ordinal", kind: str = "kind") -> DataFrame:
    """The rows that dedup_merge drops, with the order of the row that stays."""
    w = Window.partitionBy(*keys).orderBy(priority(F.col(kind)), order)
    return diffs.withColumns({"_n": F.row_number().over(w), "stays": F.first(order).over(w)}).where("_n > 1").drop("_n")


def group_kind(kinds: Column) -> Column:
    """Kind of a group from the array of its members' kinds."""
    one = F.array_distinct(kinds)
    return F.when(F.array_contains(kinds, "NUMERIC_CHANGED"), "NUMERIC_CHANGED").when(F.size(one) == 1, one[0]).when(F.arrays_overlap(kinds, F.array(F.lit("DELETED"))) & F.arrays_overlap(kinds, F.array(F.lit("ADDED"))), "MODIFIED").otherwise("MODIFIED")


def renumber(diffs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """diffs with diff_id diff_000001, ... in the order given, within the keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return diffs.withColumn("diff_id", F.concat(F.lit("diff_"), F.lpad(n.cast("string"), 6, "0")))


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison by key: kind ADDED, DELETED or CHANGED, and which values changed; equal rows go."""
    a = left.select(*keys, F.struct(*values).alias("old"))
    b = right.select(*keys, F.struct(*values).alias("new"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}")), v) for v in values]))
    kind = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "DELETED").when(F.size(changed) > 0, "CHANGED")
    return both.withColumns({"kind": kind, "changed": F.when(kind == "CHANGED", changed)}).where("kind is not null")


def positional_diff(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """keyed_diff by the place of each row within its keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return keyed_diff(left.withColumn("place", place), right.withColumn("place", place), [*keys, "place"], values)


def deoverlap(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (first, last, priority) kept in the order first, priority from high to low, last; one that overlaps a kept span of at least its priority goes.

    The decision depends on what was kept, so each key's spans are folded as one sorted array in the JVM.
    """
    rest = [c for c in spans.columns if c not in (*keys, "first", "last", "priority")]
    item = F.struct("first", (-F.col("priority")).alias("low"), "last", *rest)
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.slice("items", F.lit(1), F.lit(0))
    blocked = lambda done, x: F.exists(done, lambda k: (k["first"] < x["last"]) & (x["first"] < k["last"]) & (k["low"] <= x["low"]))
    kept = F.aggregate("items", empty, lambda done, x: F.when(blocked(done, x), done).otherwise(F.concat(done, F.array(x))))
    return listed.select(*keys, F.explode(kept).alias("m")).select(*keys, "m.first", "m.last", (-F.col("m.low")).alias("priority"), *[f"m.{c}" for c in rest])
