"""Periodic runs against brute force."""

import random

import pytest

from factorlake.llm import runs


def brute_runs(words, min_length=6, min_exponent=4):
    """(start, length, period) by comparing the words with themselves, moved by each period."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)  # a multiple of the period comes later
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def awkward(rng):
    letters = "abcd"[: rng.randint(1, 4)]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
    if rng.random() < 0.5:
        root = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        words = words[: rng.randint(0, len(words))] + root * rng.randint(2, 7) + root[: rng.randint(0, len(root))] + words[:3]
    return words


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (2, 2), (5, 3)])
def test_runs_of_small_alphabets(min_length, min_exponent):
    rng = random.Random(5)
    for _ in range(400):
        texts = [awkward(rng) for _ in range(rng.randint(1, 6))]
        assert runs.batch_runs(texts, min_length, min_exponent) == [brute_runs(t, min_length, min_exponent) for t in texts]


def test_long_stretches_and_groups_of_trees(monkeypatch):
    monkeypatch.setattr(runs, "TREE_WORDS", 50)
    rng = random.Random(6)
    texts = [awkward(rng) for _ in range(60)] + [["x"] * 3000, [str(i % 7) for i in range(2000)], [f"w{i}" for i in range(500)]]
    assert runs.batch_runs(texts, 6, 4) == [brute_runs(t) for t in texts]


def test_range_minima():
    rng = random.Random(7)
    for n in (1, 15, 16, 17, 300):
        v = runs.np.array([rng.randrange(50) for _ in range(n)], dtype=runs.np.int32)
        pairs = [sorted((rng.randrange(n), rng.randrange(n))) for _ in range(200)]
        lo, hi = runs.np.array(pairs).T
        assert runs.RangeMin(v)(lo, hi).tolist() == [int(v[a : b + 1].min()) for a, b in pairs]


def test_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(awkward(rng)), "x") for i in range(30)]
    rows += [(None, "a " * 9, None), (40, None, "y"), (41, "", ""), (42, " \t\n\x0b\f\r ", ""), (43, "no\xa0no\xa0no no", ""), (44, "Ab ab " * 5, ""), (1, rows[1][1], "x"), (45, "z " * 40_000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")  # a column named as the result's
    got = runs.find_runs(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((i, brute_runs(w), brute_collapsed(w, brute_runs(w)), len(w)) for i, t, _ in rows[:-1] for w in [runs.WORDS.findall(t or "")]), key=str)
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in got if r.doc_id != 45), key=str) == want
    (long,) = [r for r in got if r.doc_id == 45]
    assert [tuple(x) for x in long.runs] == [(0, 40_000, 1)] and long.collapsed == "z"
    assert runs.find_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="twice"):
        runs.find_runs(docs, min_exponent=1)
