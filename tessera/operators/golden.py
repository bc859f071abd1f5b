"""Checks against annotated results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(actual: DataFrame, annotated: DataFrame, key: str = "fingerprint", value: str = "outcome") -> DataFrame:
    """Counts of matched, mismatched, missing (not annotated), stale (not there any more) and repeated keys."""
    a = actual.groupBy(key).agg(F.min(value).alias("a"), F.count(F.lit(1)).alias("na"))
    b = annotated.groupBy(key).agg(F.min(value).alias("b"), F.count(F.lit(1)).alias("nb"))
    both = a.join(b, key, "full_outer")
    met = F.col("na").isNotNull() & F.col("nb").isNotNull()
    return both.agg(
        F.count_if(met & F.col("a").eqNullSafe(F.col("b"))).alias("matched"),
        F.count_if(met & ~F.col("a").eqNullSafe(F.col("b"))).alias("mismatched"),
        F.count_if(F.col("nb").isNull()).alias("missing"),
        F.count_if(F.col("na").isNull()).alias("stale"),
        F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"),
    )


def carry_forward(generated: DataFrame, existing: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Generated annotations with the classification and note that their fingerprint had before."""
    old = existing.dropDuplicates([key]).select(key, F.col("classification").alias("_c"), F.col("note").alias("_n"))
    return generated.join(old, key, "left").withColumns({"classification": F.coalesce("_c", "classification"), "note": F.coalesce("_n", "note")}).drop("_c", "_n")


def group_audit(clusters: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest groups that one cluster matches by fingerprint, action and size (matched), and the others of either side."""
    a = clusters.groupBy("fingerprint", "action", "size").agg(F.count(F.lit(1)).alias("n"))
    both = a.join(manifest.select("fingerprint", "action", "size", "group_id"), ["fingerprint", "action", "size"], "full_outer")
    state = F.when(F.col("group_id").isNull(), "UNEXPECTED").when(F.col("n").isNull(), "ABSENT").when(F.col("n") > 1, "AMBIGUOUS").otherwise("MATCHED")
    return both.withColumn("state", state)
