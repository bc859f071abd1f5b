"""The registered queries over the driver's smallest tables: columns, rows, and SQL or brute force for what can be held against it."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import queries

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
pytest.importorskip("public_tokenizers")

COLUMNS = {
    "op1_near_duplicates": "doc_id n_shingles component_id kept",
    "op2_decontaminate": "doc_id item_id edits span_start span_end",
    "op3_substrings": "doc_id n_words n_removed kept_sha256",
    "op4_suffix_array": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_toxicity": "doc_id held_out score predicted",
    "op7_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_language": "doc_id held_out lang_pred score",
    "op9_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def results(spark):
    return {name: f(spark, DATA) for name, f in queries.queries().items()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, texts, name):
    df = results[name]
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if name != "op2_decontaminate":
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(texts)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(results, name):
    duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()[name])
    df = results[name]
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_edited_texts(results, texts):
    down = sorted(texts, reverse=True)
    after = {d: down[(i + 1) % len(down)] for i, d in enumerate(down)}
    seen = {}
    for r in results["op5_fingerprint"].collect():
        t, nxt = texts[r.doc_id], texts[after[r.doc_id]]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == digest(edited.encode())
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint or edited == t or r.near_edited == 1)


def test_shards_are_even(results, texts):
    rows = results["op9_shards"].collect()
    by = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(len(by.get(i, [])) for i in range(40)) <= 1


def test_tokens(results, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in results["op10_bpe"].collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(np.array(ids, dtype="<u4").tobytes()))
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False).encode())


def test_folds(results):
    for name, n, k in (("op6_toxicity", 5, 0), ("op7_language_model", 7, 2), ("op8_language", 4, 2)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in results[name].select("doc_id", "held_out").collect())
