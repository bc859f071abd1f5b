"""The corpus pipeline on a small corpus against brute-force versions of its stages."""

import hashlib
import random

import numpy as np
import pytest

from .conftest import SCHEMA
from .test_exact import brute_bytes, brute_classes
from .test_models import edit_distance_inside

P = pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import decontaminate

    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, passage = say(40), say(60)
    texts, toxic = [None, "", "é"], set()
    for i in range(120):
        t = say(r.randint(20, 90))
        if i % 6 == 0:
            toxic.add(len(texts))
            t = f"zzbadword {t} zzawful zzbadword"
        elif i % 10 == 1:
            t = f"{t}\n{passage} {say(10)}"
        elif i % 25 == 2:
            t = f"{t} {item.upper()} {say(5)}"
        texts.append(t)
        if i % 9 == 4:
            texts.append(t + " " + r.choice(words))
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(len(texts))], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [i for i in range(len(texts)) if i not in toxic]
    classes = brute_classes([texts[i] for i in kept], 5)
    kept = [i for at, i in enumerate(kept) if classes[at][1] == at]
    cut = brute_bytes([texts[i] for i in kept], 200)
    left = {i: b.decode() for i, (_, _, _, b) in zip(kept, cut, strict=True)}
    plain = lambda t: decontaminate.normalise(t.encode())[0].tobytes().decode()
    want = plain(item)
    left = {i: t for i, t in left.items() if edit_distance_inside(want, plain(t)) > len(want) // 10}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left) and any(len(t) != len(texts[i] or "") for i, t in left.items())
    for i, t in left.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[i].n_chars == (None if texts[i] is None else len(t))
        assert got[i].source == f"s{i % 3}"


def test_stages_begin_with_a_trimmed_driver(spark, monkeypatch):
    import corpus_pipeline
    from tessera.llm import _blocks

    called = []
    monkeypatch.setattr(corpus_pipeline, "trim_driver", called.append)
    for _, f in corpus_pipeline.STAGES:
        with pytest.raises(Exception):  # noqa: B017  no documents
            f(spark, None, "")
    assert called == [spark] * len(corpus_pipeline.STAGES)
    version = tuple(int(x) for x in spark.sparkContext._jvm.System.getProperty("java.version").split("-")[0].split("."))
    assert version < (17, 0, 9) or "native heap" in _blocks.trim_driver(spark)
