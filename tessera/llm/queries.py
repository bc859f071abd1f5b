"""The thin queries over the driver's tables; each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, ctw, decontaminate, fingerprint, langid, minhash, sharding, substring, suffixarray, toxicity
from tessera.llm._text import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spark)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixarray.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("_next", F.lit(1), k))
    pairs = fingerprint.with_next(docs).withColumn("_edited", edited)
    return fingerprint.compare(pairs, ["doc_id"], "text", "_edited", "_next")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, ~held_out)
    scored = toxicity.score(docs, model, spark)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = ctw.score(docs, ~held_out, spark)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model, spark).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.external_shuffle(docs, 40, seed=9)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, tokenizer_path(), decoded="text")
    return encoded.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


OPERATORS = (op1_near_duplicates, op2_decontaminate, op3_substrings, op4_suffix_array, op5_fingerprint, op6_toxicity, op7_language_model, op8_language, op9_shards, op10_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 4 THEN [array_to_string(t[i:i + 3], ' ') FOR i IN range(1, len(t) - 2)] ELSE [array_to_string(t, ' ')] END) AS shingle FROM w WHERE len(t) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, far) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.far = e.a),
c AS (SELECT id, min(far) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

OP3_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS i, unnest([CASE WHEN i + 34 <= len(t) THEN md5(array_to_string(t[i:i + 34], ' ')) END FOR i IN range(1, len(t) + 1)]) AS win FROM w),
r AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM p),
g AS (SELECT *, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, count(i) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Suffix sorting, sketches, scores, tokenizing and shuffles have no SQL form, or one too slow for whole tables; tests hold them against brute force."""
    return {"op1_near_duplicates": OP1_SQL, "op3_substrings": OP3_SQL}
