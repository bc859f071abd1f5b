"""What is rare in a large input still counts."""

import random

import numpy as np

from tessera.llm import langid, toxicity


def test_every_word_is_a_term():
    r = random.Random(11)
    word = lambda k: "".join(r.choice(k) for _ in range(10))
    bad, plain = [word("nopqrstuvw") for _ in range(100)], [word("abcdefghij") for _ in range(300)]
    rows = []
    for i in range(3000):
        w = [r.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            w[:5] = r.sample(bad, 5)
        rows.append((str(i), *toxicity.features(" ".join(w).encode()), int(i % 5 == 0)))
    model = toxicity.Model(rows)
    assert len(model.terms) == 400
    assert all(model.score(x.encode())[0] > 0.5 for x in bad)


def test_a_small_share_of_a_long_text_is_a_language():
    table = np.full((3, 1000), 1e-6)
    for k in range(3):
        table[k, 10 * k : 10 * k + 10] = 0.09
    n = np.array([9950.0] * 10 + [50.0] * 10)
    found = dict(langid.mixture(np.arange(20), n, np.log(table)))
    assert list(found) == [0, 1] and abs(found[1] - 0.005) < 1e-3
    assert list(dict(langid.mixture(np.arange(10), np.full(10, 10000.0), np.log(table)))) == [0]
