"""Order-preserving batches under budgets, and what external answers are checked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_batches(units: DataFrame, keys: list[str], order: str, limits: dict[str, float], drop_oversize: bool = False) -> DataFrame:
    """units with batch: greedy bins in order; a bin closes when the next unit would push any sum over its limit.

    A unit over a limit by itself is an error: its rows get oversize = true (or go). The running sums start anew
    with each bin, so the units of one key are folded as one sorted array in the JVM.
    """
    over = reduce(lambda a, b: a | b, [F.col(c) > m for c, m in limits.items()])
    units = units.withColumn("oversize", over)
    if drop_oversize:
        units = units.where("not oversize")
    item = F.struct(F.col(order).alias("o"), *[F.col(c).cast("double").alias(c) for c in limits])
    listed = units.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).alias("bin"), *[F.lit(0.0).alias(c) for c in limits], F.expr("cast(array() as array<int>)").alias("bins"))

    def step(s: Column, x: Column) -> Column:
        full = reduce(lambda a, b: a | b, [s[c] + x[c] > m for c, m in limits.items()]) & (F.size(s["bins"]) > 0)
        to = F.when(full, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(to.alias("bin"), *[(F.when(full, 0.0).otherwise(s[c]) + x[c]).alias(c) for c in limits], F.concat(s["bins"], F.array(to)).alias("bins"))

    bins = listed.select(*keys, F.explode(F.arrays_zip(F.transform("items", lambda x: x["o"]).alias("o"), F.aggregate("items", zero, step, lambda s: s["bins"]).alias("b"))).alias("z"))
    return units.join(bins.select(*keys, F.col("z.o").alias(order), F.col("z.b").alias("batch")), [*keys, order])


def output_tokens(facts: Column, candidates: Column) -> Column:
    """Token estimate of an answer; 256, 220 and 48 are fixed values of the planner."""
    return F.ceil((256 + 220 * facts + 48 * candidates) / 2)


def batch_id(sha256: Column, texts: Column, version: str) -> Column:
    """A stable id of a batch: file, version and block contents."""
    return F.concat(F.lit("batch_"), F.substring(F.sha2(F.concat_ws("\u001f", F.lit(version), sha256, texts), 256), 1, 24))


def recovery_split(rows: DataFrame, keys: list[str], order: str, numeric: bool) -> DataFrame:
    """rows with part: numeric blocks in threes (single ones if there are three or fewer), text blocks in two halves."""
    w = Window.partitionBy(*keys).orderBy(order)
    if not numeric:
        return rows.withColumn("part", F.ntile(2).over(w) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(w) - 1
    return rows.withColumn("part", F.when(n > 3, F.floor(at / 3)).otherwise(at).cast("int"))


def outstanding(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Batches without an answer: what a re-drive has to ask."""
    return batches.join(answers.select("batch"), "batch", "left_anti")


def read_through(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with their value, misses) of a content-addressed cache."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")


def checkpoint_lookup(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """The value of each key (digest): of the own task before the source task, then the latest. wanted: (task, source, digest); store: (task, digest, value, created_at)."""
    s = store.select(F.col("task").alias("owner"), "digest", "value", "created_at")
    rows = wanted.join(s, "digest").where((F.col("owner") == F.col("task")) | (F.col("owner") == F.col("source")))
    rank = F.struct((F.col("owner") == F.col("task")).alias("own"), "created_at")
    return rows.groupBy("task", "digest").agg(F.max_by("value", rank).alias("value"))


def insert_once(store: DataFrame, new: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): keys that the store has with another value are conflicts, with the same value nothing."""
    old = store.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_has"))
    met = new.join(old, keys, "left")
    return met.where("_has is null").drop("_old", "_has"), met.where(F.col("_has") & ~F.col("_old").eqNullSafe(F.col(value))).drop("_has")


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the new rows in place of those with the same key."""
    return store.join(new.select(*keys), keys, "left_anti").unionByName(new)


def overview(blocks: DataFrame, key: str = "doc", edge: int = 4, most: int = 60) -> DataFrame:
    """The first and last ``edge`` blocks, all headings and tables; over ``most`` rows the first and last halves of them."""
    up, down = Window.partitionBy(key).orderBy("ordinal"), Window.partitionBy(key).orderBy(F.desc("ordinal"))
    chosen = blocks.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)}).where((F.col("_u") <= edge) | (F.col("_d") <= edge) | F.col("type").isin("TABLE", "HEADER") | F.col("heading"))
    ranked = chosen.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    return ranked.where((F.col("_u") <= most // 2) | (F.col("_d") <= most - most // 2)).drop("_u", "_d")


def context(rows: DataFrame, keys: list[str], order: str, text: str, k: int = 1) -> DataFrame:
    """rows with context: the texts from k before to k after."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def mapping_batches(targets: DataFrame, keys: list[str], order: str, most: int = 8, most_chars: int = 12_000) -> DataFrame:
    """Batches of up to ``most`` target facts and a number of characters."""
    return plan_batches(targets.withColumn("units", F.lit(1)), keys, order, {"units": most, "chars": most_chars})


def review_batches(facts: DataFrame, blocks: DataFrame, keys: list[str], k: int = 1, most_chars: int = 12_000) -> DataFrame:
    """Facts with the text of their block and its neighbours, in batches by characters. facts: (keys, block, fact); blocks: (keys, ordinal, text)."""
    around = context(blocks, keys, "ordinal", "text", k).select(*keys, F.col("ordinal").alias("block"), "context")
    rows = facts.join(around, [*keys, "block"]).withColumn("chars", F.length("context"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("block", "fact"))
    return plan_batches(rows.withColumn("o", order), keys, "o", {"chars": most_chars}).drop("o")


def reduce_answers(answers: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers of complete batches, batches to ask again): a batch is complete if each of its items is answered exactly once.

    answers: (batch, item, ...); expected: (batch, item).
    """
    a = answers.groupBy("batch", "item").agg(F.count(F.lit(1)).alias("n"))
    e = expected.select("batch", "item", F.lit(True).alias("asked")).distinct()
    state = e.join(a, ["batch", "item"], "full_outer").groupBy("batch").agg(F.bool_and((F.coalesce("n", F.lit(0)) == 1) & F.coalesce("asked", F.lit(False))).alias("ok"))
    good = state.where("ok").select("batch")
    return answers.join(good, "batch", "left_semi"), expected.select("batch").distinct().join(good, "batch", "left_anti")


def next_wave(batches: DataFrame, answers: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """The batches to ask next: of each key the unanswered ones of its first wave of ``size`` that isn't answered in full. batches: (keys, order, batch)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    open_ = outstanding(batches.withColumn("wave", F.floor(n / size).cast("int")), answers)
    first = open_.groupBy(*keys).agg(F.min("wave").alias("wave"))
    return open_.join(first, [*keys, "wave"])


def payloads(facts: DataFrame, keys: list[str], order: str, item: str, size: int) -> DataFrame:
    """(keys, batch, items): the items of each key in order, ``size`` to a payload."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    numbered = facts.withColumns({"_n": n, "batch": F.floor(n / size).cast("int")})
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col(item).alias("item"))))
    return numbered.groupBy(*keys, "batch").agg(F.transform(listed, lambda x: x["item"]).alias("items"))
