import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA, ids=None):
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and very long ones."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(150)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, other = words(60), words(40)
    texts = [None, "", " \t\n ", "one", "one", "One two", "a b c d", "A b C d"]
    for _ in range(25):
        w = words(r.randint(1, 150))
        texts.append(" ".join(w))
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            texts.append("  ".join(w[:at] + passage + w[at:]))
        if r.random() < 0.3:
            texts.append("\n".join(other + w))
    base = words(120)
    for _ in range(12):
        w = list(base)
        w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[20]] * 3 + [" ".join(words(4000)), "ab " * 400, "x" * 3000, "x" * 1500]
    return texts
