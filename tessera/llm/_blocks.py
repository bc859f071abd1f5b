"""Blocks of documents and packed counting of hashes, shared by the exact substring operators.

A block is a few MB of whole documents chosen by a hash of their identity, so it can be met again
after a shuffle and after a lost executor. Blocks send each other packed arrays of hashes instead of
a row for each: a bucket (a range of hash values) counts what all blocks sent it and answers each
block with a code for each of its hashes. A block sends each hash once, however often it has it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tessera.llm._text import text_bytes

BLOCK_BYTES = 8 << 20
MOST_PARTS = 8192


def checkpoint_dir(spark: SparkSession) -> None:
    """Takes the cluster's shared folder; sets one of our own only where none is set and all runs on this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp())


def fresh(taken: list[str], *names: str) -> list[str]:
    """These names with as many underscores before them as no column of taken has, whatever its case."""
    lower, mark = {c.lower() for c in taken}, "_"
    while any(f"{mark}{n}".lower() in lower for n in names):
        mark += "_"
    return [mark + n for n in names]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession) -> None:
    """Sends texts to Python a thousand at a time instead of ten thousand, so that a batch of long ones stays small."""
    if int(spark.conf.get(BATCH)) > 1000:
        spark.conf.set(BATCH, "1000")


def release() -> None:
    """Hands the memory that a Python worker no longer needs back: workers live on and serve other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def trim() -> None:
    """release without a search for cycles: after each group, as workers take turns and all would keep what they had at most."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> str | None:
    """Has the driver's JVM hand back the native memory that its threads no longer need, and returns what it says; None if it doesn't know how."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    named = jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):
        # through the interface, as the server's own class is closed to reflection
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; the shuffle files that led to it are freed."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(CLEANUP, before)
        trim_driver(spark)


def identity(docs: DataFrame, text: Column, seed: int) -> Column:
    """A hash of a row's plain columns and text: only rows that are equal in all of them have the same."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, ArrayType, StructType)) and f.dataType.typeName() != "variant"]
    return F.xxhash64(F.lit(seed), *plain, text)


def blocked(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """docs with _block and the text's bytes as _t, dealt by block; the number of blocks and of bytes.

    Columns of docs that are called so must be renamed before (see ``shielded``).
    """
    docs = docs.withColumn("_t", text_bytes(docs, text))
    total = docs.agg(F.sum(F.octet_length("_t").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    at = F.pmod(identity(docs.drop("_t"), F.col("_t"), 3), F.lit(n)).cast("long")
    return docs.withColumn("_block", at).repartition(min(n, MOST_PARTS), "_block"), n, total


def shielded(docs: DataFrame, *inner: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns renamed that are called like inner ones; their names by the new ones."""
    lower = {n.lower() for n in inner}
    taken = [c for c in docs.columns if c.lower() in lower]
    back = dict(zip(fresh([*docs.columns, *inner], *(f"shield{i}" for i in range(len(taken)))), taken, strict=True)) if taken else {}
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def per_block(left: DataFrame, f: Callable[[int, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """f's rows (dicts of columns) for each block."""
    to = arrow_schema(left.sparkSession, schema)

    def run(k: tuple, t: pa.Table) -> pa.Table:
        made = rows_table(f(k[0].as_py(), t), to)
        trim()
        return made

    return left.groupBy("_block").applyInArrow(run, schema)


def per_block_with(left: DataFrame, right: DataFrame, f: Callable, schema: str | None = None) -> DataFrame:
    """f(block, rows of left, rows of right) for each block; a table if schema is None-typed, else dict rows."""
    to = arrow_schema(left.sparkSession, schema)

    def run(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        made = f(k[0].as_py(), a, b)
        made = made if isinstance(made, pa.Table) else rows_table(made, to)
        trim()
        return made

    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def rows_table(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def runs(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, begin, end) of each run of equal keys."""
    if not len(sorted_keys):
        return []
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return list(zip(sorted_keys[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_keys)], strict=True))


COUNTED = "_block long, _bucket long, keys binary, many binary, extra binary"


def count_packed(sent: DataFrame, width: str, parts: int, code: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Answers (_block, _bucket, codes, extra) to rows (_block, _bucket, keys, many, extra).

    keys: a packed array (dtype width) of distinct values; many: how often the block has each, as
    packed 32-bit counts; codes: a byte for each key, by default whether it occurs more than once.
    """

    def run(k: tuple, t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), dtype=width) for x in t["keys"]]
        many = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in t["many"]]).astype(np.int64)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable") if flat.dtype.names is None else np.lexsort([flat[n] for n in flat.dtype.names])
        s = flat[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(first) - 1
        total = np.bincount(group, weights=many[order]).astype(np.int64)
        out = np.empty(len(flat), dtype=np.uint8)
        out[order] = (code(total) if code else total > 1)[group]
        ends = np.cumsum([len(x) for x in keys])
        del flat, order, s, first, group
        trim()
        return pa.table({"_block": t["_block"], "_bucket": t["_bucket"], "codes": pa.array([out[e - len(x) : e].tobytes() for e, x in zip(ends.tolist(), keys, strict=True)], pa.binary()), "extra": t["extra"]})

    return sent.repartition(parts, "_bucket").groupBy("_bucket").applyInArrow(run, "_block long, _bucket long, codes binary, extra binary")
