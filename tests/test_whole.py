"""The queries read whole documents: what stands far down a text counts."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from tessera.functions import similarity as sim
from tessera.operators import pages
from tessera.plans import queries as q


@pytest.fixture
def folder(spark, tmp_path):
    """Writes texts as the documents of a folder."""

    def write(texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_of_whole_texts(spark, folder):
    r = random.Random(3)
    lines = [words(r, 4) for _ in range(45)]
    got = q.q_document_similarity(spark, folder(["\n".join(lines)])).collect()
    flat = [x.replace(" ", "") for x in lines]
    a, b = "".join(flat), "".join(x + "2024" * (i % 7 == 2) for i, x in enumerate(flat) if i % 5 != 3)
    assert [x.similarity for x in got] == [pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))]


@pytest.mark.parametrize("n,letters", [(700, "ab"), (1700, "abcdefgh"), (1300, "aé漢😀")])
def test_banded_lcs_is_exact(n, letters):
    r = random.Random(n)
    a = "".join(r.choice(letters) for _ in range(n))
    others = ["".join(c for c in a if r.random() > share) for share in (0.02, 0.3)]
    for b in [*others, a[n // 2 :] + a[: n // 2], "".join(r.choice(letters) for _ in range(900))]:
        assert sim.lcs_length(a, b) == sim.lcs_length(b, a) == lcs(a, b)


def test_pages_of_whole_documents(spark, folder):
    r = random.Random(4)
    lines = [words(r, 6) for _ in range(30)]
    rows = {x.ordinal: x.pages for x in q.q_page_alignment(spark, folder(["\n".join(lines)])).collect()}
    assert rows == {i: [i * 2 // 10] for i in range(30)}


def test_linear_alignment_looks_at_all_later_units():
    r = random.Random(5)
    local = [words(r, 4) for _ in range(320)]
    # a part that only the other side has, then the same units; one that stands twice is told by nothing
    external = [words(r, 4) for _ in range(350)] + local[:300] + [local[310], local[310]]
    assert len(local) * len(external) > pages.STATES
    assert pages.align_spans(local, external) == [(i, 350 + i, 351 + i) for i in range(300)]


def test_large_alignment_is_the_best_one():
    r = random.Random(8)
    rest = [words(r, 4) for _ in range(459)]
    first = words(r, 4)
    # the first unit stands last on the other side: taken on its own it would leave the others nothing
    local, external = [first, *rest], [*rest, first]
    assert len(local) * len(external) > pages.STATES
    assert pages.align_spans(local, external) == [(i + 1, i, i + 1) for i in range(459)]


def every_state(n, m, found, either):
    """_certain by a table of all n * m states."""
    best = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], *[(best[i + 1][e][0] + 1, round(best[i + 1][e][1] + s, 9)) for e, s in found[i].get(j, [])])
    out, i, j = [], 0, 0
    while i < n and j < m:
        now = best[i][j]
        good = [e for e, s in found[i].get(j, []) if (best[i + 1][e][0] + 1, round(best[i + 1][e][1] + s, 9)) == now]
        if len(good) == 1 and best[i + 1][j] != now and best[i][j + 1] != now:
            out.append((i, j, good[0]))
            i, j = i + 1, good[0]
        elif (either and good) or best[i + 1][j] == now:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("either", [True, False])
def test_certain_runs_are_those_of_all_states(either):
    r = random.Random(9)
    for _ in range(1500):
        n, m, share, scores = r.randint(0, 9), r.randint(0, 9), r.choice([0.1, 0.4, 0.9]), r.choice([[1.0], [0.82, 0.9, 1.0]])
        found = [{j: [(e, r.choice(scores)) for e in sorted(r.sample(range(j + 1, m + 1), r.randint(1, min(3, m - j))))] for j in range(m) if r.random() < share} for _ in range(n)]
        assert pages._certain(n, m, found, either) == every_state(n, m, found, either)


def test_equal_runs_need_no_other_runs(monkeypatch):
    r = random.Random(10)
    lines = [words(r, 8) for _ in range(60)]
    halves = [x for line in lines for x in (line[:20], line[20:])]
    monkeypatch.setattr(pages, "_spans", lambda *x: pytest.fail("texts are matched that cannot count"))
    assert pages.align_spans(lines, halves) == [(i, 2 * i, 2 * i + 2) for i in range(60)]


def test_equal_runs_are_aligned_as_all_runs():
    r, alone = random.Random(11), 0
    for _ in range(600):
        letters = r.choice(["a", "ab", "abcé "])
        say = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))  # noqa: E731, B023
        known = [say(6) for _ in range(3)]
        local = [r.choice([*known, say(20)]) for _ in range(r.randint(0, 7))]
        external = []
        for text in local:
            external += [say(4)] * r.choice([0, 0, 0, 1])
            while text:
                n = r.choice([1, 3, len(text)])
                external.append(text[:n])
                text = text[n:]
        flat, parts = ([x.replace(" ", "") for x in side] for side in (local, external))
        alone += pages._exact(flat, parts) is not None
        assert pages.align_spans(local, external) == every_state(len(flat), len(parts), pages._spans(flat, parts), True)
    assert 100 < alone < 600


def test_spans_are_those_of_all_runs():
    r = random.Random(6)
    for _ in range(150):
        local = ["".join(r.choice("abcé") for _ in range(r.randint(0, 24))) for _ in range(5)]
        whole, external = "".join(local), []
        while whole:
            n = r.randint(1, 12)
            external.append("".join(c for c in whole[:n] if r.random() < 0.9))
            whole = whole[n:]
        want = []
        for text in local:
            found = {}
            for j in range(len(external)):
                for e in range(j + 1, min(len(external), j + pages.SPAN) + 1):
                    run = "".join(external[j:e])
                    if text and run:
                        alike = min(len(text), len(run)) / max(len(text), len(run)) if text in run or run in text else SequenceMatcher(None, text, run, autojunk=False).ratio()
                        if alike >= (pages.ALIKE_LONG if e == j + 1 and len(text) >= pages.LONG else pages.ALIKE):
                            found.setdefault(j, []).append((e, alike))
            want.append(found)
        assert [{j: sorted(x) for j, x in f.items()} for f in pages._spans(local, external)] == want
