"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters whole records uniformly over memory-sized buckets by a seeded hash of their
identity; pass two shuffles each bucket with a seeded Fisher-Yates permutation. Buckets laid end to
end give one uniform random order; row i of it goes to shard i mod n, slot i div n, so counts differ
by one at most and slots have no gaps. A lost executor repeats its buckets with the same seeds.

Null texts have size 16 and checksum 0. Rows that repeat are shuffled like others; only rows that are equal in all plain
columns must share a bucket, and their order among themselves makes no difference. Ties of the rows' hashes
go by the text's. Extra columns travel with their record, whatever they are called; columns named like the outputs are replaced.
Very long texts fill a bucket of their own size. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm._blocks import MOST_PARTS, identity, shielded

BUCKET_BYTES = 8 << 20
GROUP = 1024


def bucket_of(docs: DataFrame, text: str, seed: int, buckets: int) -> Column:
    return F.pmod(identity(docs, F.col(f"`{text}`"), seed), F.lit(buckets)).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of n rows (numpy's permutation is the Fisher-Yates shuffle)."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def external_shuffle(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard (int) and slot (long): a uniform random order dealt over shards."""
    docs, back = shielded(docs.drop("shard", "slot"), "_b", "_h", "_tie", "_begin")
    total, rows = docs.agg(F.sum(F.octet_length(text).cast("long") + 16), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    at = bucket_of(docs, text, seed, buckets)
    # where each bucket begins in the global order: sums within groups of buckets, then over the groups
    counts = docs.groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.floor(F.col("_b") / GROUP))
    within = F.sum("_n").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_gn")).withColumn("_go", F.sum("_gn").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)))
    begins = counts.withColumn("_w", within).join(groups, "_g").select("_b", (F.coalesce("_w", F.lit(0)) + F.coalesce("_go", F.lit(0))).cast("long").alias("_begin"))
    names = docs.columns

    def deal(bucket: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n, begin = left.num_rows, right["_begin"][0].as_py() if right.num_rows else 0
        # arrival order depends on the network; the rows' hashes do not
        order = np.lexsort((left["_tie"].to_numpy(), left["_h"].to_numpy()))
        place = np.empty(n, dtype=np.int64)
        place[order] = fisher_yates(n, (seed << 32) + bucket[0].as_py()) + begin
        out = left.select(names)
        out = out.append_column("shard", pa.array((place % shards).astype(np.int32)))
        return out.append_column("slot", pa.array(place // shards))

    parts = max(1, min(buckets, MOST_PARTS))
    left = docs.withColumns({"_b": at, "_h": F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`")), "_tie": identity(docs, F.col(f"`{text}`"), seed + 2)}).repartition(parts, "_b")
    return left.groupBy("_b").cogroup(begins.groupBy("_b")).applyInArrow(deal, StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])).withColumnsRenamed(back)


def write_shards(shuffled: DataFrame, path: str, writer: Callable[[DataFrame], object] | None = None) -> None:
    """Writes one folder for each shard, rows in slot order within each file."""
    (writer or (lambda d: d.write.partitionBy("shard").parquet(path)))(shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot"))
