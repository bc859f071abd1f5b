"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Null and empty texts pass all stages (null texts stay null, and encode to no ids); rows that repeat are near duplicates of each
other and share an id, so they stay or go together; rows with a null id are never dropped as duplicates. Empty tables give an empty
result. Ties and very long texts are handled as the operators say. Columns beyond those of ``documents`` are kept by all stages but the last.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, minhash, suffixarray, toxicity
from tessera.llm._blocks import checkpoint_dir, trim_driver
from tessera.llm._text import fold
from tessera.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """f after the driver's JVM has handed back what the stages before left."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim_driver(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples are mostly toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), 5) != 0)
    return toxicity.clean(docs, model, spark)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs, k=5, percent=80)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 and more that occur twice are cut out; n_chars follows the text."""
    return suffixarray.strip(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage within the edit budget go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian 32-bit) of each text, and the digest of what they decode to."""
    decoded = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), tokenizer_path(), decoded="text")
    return decoded.select("doc_id", "lang", "source", "n_chars", bpe.n_tokens().alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("suffix array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Suffix sorting, banded alignment and byte-pair merges have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents. What lies between two stages is kept in the shared checkpoint folder until the later one is written."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
