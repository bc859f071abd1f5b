"""Differences that say the same thing: coordinates, pair reasons, safe groups, boundary noise and what is published.

Differences are rows (pair, diff_id, kind, before, after, page, place) with the match texts of both sides. A coordinate is
(TABLE, table and field) or (PARAGRAPH, chapter). Pairs are formed within one coordinate only, and never within one of
its sides, so a pair joins a deletion with an addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CLAUSE_NUMBER, value_tokens
from tessera.operators.graph import connected, topology

# Words that turn a meaning round, what makes a text a formula, and marks that boundary texts consist of.
NEGATION = "不|无|禁止|不得|除外|但书"
FORMULA = "[=×÷*/+]"
VALUE = r"\d|金额|价款|日期|期限|编号"
PAGE_MARK = r"^(?:第?\d+页?(?:共\d+页)?|[-—–]?\d+[-—–]?|目录|页眉|页脚)$"
NEAR_PAGES = 1


def coordinates(diffs: DataFrame) -> DataFrame:
    """diffs (with table_pair, field and chapter, each null if unknown) with coordinate: the kind, and what candidates must share."""
    table = F.struct(F.lit("TABLE").alias("kind"), F.col("table_pair").cast("string").alias("at"), F.col("field").alias("name"))
    text = F.struct(F.lit("PARAGRAPH").alias("kind"), F.lit(None).cast("string").alias("at"), F.coalesce("chapter", F.lit("")).alias("name"))
    return diffs.withColumn("coordinate", F.when(F.col("table_pair").isNotNull(), table).otherwise(text))


def body(text: Column) -> Column:
    """What a text says, without the number of its clause."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CLAUSE_NUMBER, "")


def pair_reason(l: Column, r: Column) -> Column:
    """(candidate, reason): are two differences of one coordinate one and the same text, and why or why not. l, r: structs (kind, before, after)."""
    changed = lambda x: x["before"].isNotNull() & x["after"].isNotNull() & (x["before"] != x["after"])
    text = lambda x: body(F.coalesce(x["before"], x["after"]))
    opposite = (l["kind"] != r["kind"]) & l["kind"].isin("ADDED", "DELETED") & r["kind"].isin("ADDED", "DELETED")
    same = (text(l) == text(r)) & (text(l) != "") & (value_tokens(text(l)) == value_tokens(text(r)))
    answer = lambda ok, code: F.struct(F.lit(ok).alias("candidate"), F.lit(code).alias("reason"))
    return (
        F.when(changed(l) | changed(r), answer(False, "VALUE_MISMATCH"))
        .when(opposite & (text(l).rlike(FORMULA) | text(r).rlike(FORMULA)), answer(True, "COMPOSITE_EQUIVALENCE_REQUIRED"))
        .when(same, answer(True, "EXACT_CONTENT_EQUIVALENCE"))
        .when(opposite & (text(l) != "") & (text(r) != ""), answer(False, "COMPOSITE_EQUIVALENCE_REQUIRED"))
        .otherwise(answer(False, "VALUE_MISMATCH"))
    )


def equivalent_pairs(diffs: DataFrame) -> DataFrame:
    """(pair, a, b, reason): additions and deletions of one coordinate that have the same content, one to one in order."""
    located = coordinates(diffs).withColumn("_text", body(F.coalesce("before", "after"))).where((F.col("_text") != "") & F.col("kind").isin("ADDED", "DELETED"))
    w = Window.partitionBy("pair", "coordinate", "kind", "_text").orderBy("diff_id")
    numbered = located.withColumn("_n", F.row_number().over(w))
    side = lambda kind, to: numbered.where(F.col("kind") == kind).select("pair", "coordinate", "_text", "_n", F.col("diff_id").alias(to), F.struct("kind", "before", "after").alias(f"_{to}"))
    met = side("DELETED", "a").join(side("ADDED", "b"), ["pair", "coordinate", "_text", "_n"])
    return met.withColumn("_r", pair_reason(F.col("_a"), F.col("_b"))).where("_r.candidate").select("pair", "a", "b", "_r.reason")


def rejected_pairs(diffs: DataFrame) -> DataFrame:
    """(pair, reason, n): how many additions and deletions of one coordinate have no equal counterpart, by what keeps them apart."""
    taken = equivalent_pairs(diffs)
    used = taken.select("pair", F.explode(F.array("a", "b")).alias("diff_id"))
    left = coordinates(diffs).join(used, ["pair", "diff_id"], "left_anti")
    both = left.where("kind in ('ADDED', 'DELETED')").groupBy("pair", "coordinate").agg(F.countDistinct("kind").alias("kinds"))
    why = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), "VALUE_MISMATCH").when(F.col("kinds") == 2, "COMPOSITE_EQUIVALENCE_REQUIRED").otherwise("COORDINATE_MISMATCH")
    return left.join(both, ["pair", "coordinate"], "left").groupBy("pair", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clusters(links: DataFrame) -> DataFrame:
    """(cluster, diff_id): the components of links (a, b) between differences; a cluster is named by its first."""
    return connected(links.select("a", "b")).select(F.col("component").alias("cluster"), F.col("node").alias("diff_id"))


def safe(members: DataFrame) -> DataFrame:
    """(pair, cluster, safe): clusters whose two sides have the same texts and values, and no word that turns a meaning round.

    members: (pair, cluster, before, after).
    """
    texts = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    values = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(texts(c), value_tokens))))
    turned = F.bool_or(F.coalesce(F.col("before").rlike(NEGATION), F.lit(False)) | F.coalesce(F.col("after").rlike(NEGATION), F.lit(False)))
    same = (F.size(texts("before")) > 0) & (texts("before") == texts("after")) & (values("before") == values("after"))
    return members.groupBy("pair", "cluster").agg((same & ~turned).alias("safe"))


def boundary_noise(diffs: DataFrame) -> DataFrame:
    """(pair, diff_id): differences that only come from where a reader cut the text.

    A page mark is one, and so is a one-sided text without values that a longer difference of the same or the next page
    contains. Pages are joined, so a document is never compared with itself as a whole.
    """
    one = F.coalesce("before", "after")
    mark = PAGE_MARK.replace("$", r"\z")  # Java's $ also holds before a last line separator
    marks = diffs.where(F.coalesce(F.col("before"), F.lit("")).rlike(mark) | F.coalesce(F.col("after"), F.lit("")).rlike(mark)).where(F.col("before").isNull() | F.col("after").isNull()).select("pair", "diff_id")
    small = diffs.where((F.col("before").isNull() | F.col("after").isNull()) & ~one.rlike(VALUE) & (F.length(one) > 0)).select("pair", "diff_id", one.alias("_s"), F.explode(F.sequence(F.col("page") - NEAR_PAGES, F.col("page") + NEAR_PAGES)).alias("page"))
    large = diffs.select("pair", F.col("diff_id").alias("_other"), "page", F.explode(F.array_compact(F.array("before", "after"))).alias("_l"))
    held = small.join(large, ["pair", "page"]).where((F.col("diff_id") != F.col("_other")) & (F.length("_s") < F.length("_l")) & F.col("_l").contains(F.col("_s"))).select("pair", "diff_id")
    return marks.unionByName(held).distinct()


def residual_safe(diffs: DataFrame, residue: DataFrame) -> DataFrame:
    """(pair, diff_id, safe): is every paragraph that one side has beyond the common text a heading, a page mark or a connecting word? residue: (pair, diff_id, text, heading)."""
    connecting = F.col("text").rlike(r"^(?:及|和|与|或|以及|并且?|其中|如下|续)[:：]?$")
    each = residue.withColumn("_ok", F.col("heading") | F.col("text").rlike(PAGE_MARK) | connecting)
    return diffs.select("pair", "diff_id").join(each.groupBy("pair", "diff_id").agg(F.bool_and("_ok").alias("safe")), ["pair", "diff_id"], "left").withColumn("safe", F.coalesce("safe", F.lit(True)))


def published(diffs: DataFrame) -> dict[str, DataFrame]:
    """kept (numbered anew), audit and stats of the deterministic filter: equal text that stands elsewhere, and boundary noise, go.

    Formulas of the same text stay: only a composite check could tell that they say the same.
    audit: (pair, reason, cluster, removed); stats: one row for each pair.
    """
    links = equivalent_pairs(diffs).where("reason = 'EXACT_CONTENT_EQUIVALENCE'").select("pair", "a", "b").distinct()
    ids = diffs.select("pair", "diff_id", "before", "after")
    named = links.select("pair", "a", "b", F.explode(F.array("a", "b")).alias("diff_id")).join(ids, ["pair", "diff_id"])
    # an id that repeats stands for several texts: it is enough that one of them is on both sides
    each = named.select("pair", F.struct("a", "b", F.coalesce("before", "after").alias("text")).alias("cluster"), "before", "after")
    sure = safe(each).where("safe").select("pair", "cluster.a", "cluster.b").distinct()
    equal = sure.select("pair", F.col("a").alias("cluster"), F.explode(F.array("a", "b")).alias("diff_id")).distinct()
    noise = boundary_noise(diffs)
    groups = equal.groupBy("pair", "cluster").agg(F.array_sort(F.collect_list("diff_id")).alias("removed")).select("pair", F.lit("EQUIVALENT_NO_CHANGE").alias("reason"), "cluster", "removed")
    alone = noise.select("pair", F.lit("BOUNDARY_NOISE").alias("reason"), F.lit(None).cast(diffs.schema["diff_id"].dataType).alias("cluster"), F.array("diff_id").alias("removed"))
    flag = lambda d, to: d.select("pair", "diff_id", F.lit(True).alias(to)).distinct()
    marked = diffs.join(flag(equal, "_equal"), ["pair", "diff_id"], "left").join(flag(noise, "_noise"), ["pair", "diff_id"], "left")
    stay = F.col("_equal").isNull() & F.col("_noise").isNull()
    stays = marked.where(stay).drop("_equal", "_noise")
    number = F.row_number().over(Window.partitionBy("pair").orderBy("diff_id"))
    counted = marked.groupBy("pair").agg(F.count(F.lit(1)).alias("raw_candidate_count"), F.count_if("_equal").alias("equivalent_filtered_count"), F.count_if("_noise").alias("boundary_noise_filtered_count"), F.count_if(stay).alias("final_published_risk_count"))
    stats = counted.join(groups.groupBy("pair").agg(F.count(F.lit(1)).alias("equivalent_group_count")), "pair", "left").na.fill(0, ["equivalent_group_count"])
    stats = stats.select("pair", "raw_candidate_count", "equivalent_filtered_count", "boundary_noise_filtered_count", "equivalent_group_count", "final_published_risk_count")
    return {"kept": stays.withColumn("published_id", F.concat(F.lit("diff_"), F.lpad(number.cast("string"), 6, "0"))), "audit": groups.unionByName(alone), "stats": stats}


def summary(members: DataFrame) -> DataFrame:
    """One row for each cluster: members, kinds, the lengths of their texts (never the texts) and a fingerprint that the order does not change.

    members: (cluster, diff_id, kind, before, after).
    """
    each = F.struct("diff_id", "kind", F.length("before").alias("before_chars"), F.length("after").alias("after_chars"))
    listed = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("candidates"), F.array_sort(F.collect_list(each)).alias("members"))
    return listed.join(topology(members, "cluster", "diff_id", "kind"), "cluster")


def discovery_audit(members: DataFrame, action: str = "action", kind: str = "kind") -> DataFrame:
    """(what, name, clusters, fragments): clusters and their members by kind, by action and by size. members: (cluster, ...)."""
    each = members.groupBy("cluster").agg(F.min(kind).alias("_k"), F.min(action).alias("_a"), F.count(F.lit(1)).alias("n"))
    named = each.select("n", F.explode(F.array(*[F.struct(F.lit(w).alias("what"), c.alias("name")) for w, c in (("KIND", F.col("_k")), ("ACTION", F.col("_a")), ("SIZE", F.col("n").cast("string")))])).alias("x"))
    return named.groupBy("x.what", "x.name").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("fragments"))


def replay(published_ids: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: expected differences that are published, that are lost, and published ones that were expected to go. gold: (pair, diff_id, keep)."""
    marked = gold.join(published_ids.select("pair", "diff_id", F.lit(True).alias("_p")), ["pair", "diff_id"], "left")
    there = F.coalesce("_p", F.lit(False))
    return marked.agg(F.count_if(F.col("keep") & there).alias("kept"), F.count_if(F.col("keep") & ~there).alias("lost"), F.count_if(~F.col("keep") & there).alias("not_removed"), F.count_if(~F.col("keep") & ~there).alias("removed"))
