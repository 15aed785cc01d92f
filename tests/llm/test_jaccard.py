import random

import numpy as np
import pytest

from siftmark.llm import jaccard
from siftmark.llm.graph import components


def brute(rows):
    """Component of every row by comparing all pairs of word-shingle sets."""
    sets = []
    for _, text in rows:
        table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = [w for w in (text or "").translate(table).replace("\n", " ").replace("\t", " ").split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    top = {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets))


def edited(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]), vocabulary)))
    for _ in range(30):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        texts.append(" ".join(passage + own))
    texts += ["", None, "one two", "ONE two", "one\ttwo three", texts[0], texts[0], " ".join(vocabulary * 3)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [400, 5])
def test_components_are_those_of_brute_force(docs_of, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    got = [tuple(r) for r in jaccard.near_duplicates(docs_of(corpus)).collect()]
    assert sorted(got) == brute(corpus)


def test_large_group_of_near_copies(docs_of):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.02, vocabulary))) for i in range(300)]
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs_of(rows)).collect()) == brute(rows)


def test_nulls_repeats_and_ids_under_two_texts(docs_of):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(1, a), (1, a), (2, b), (1, b), (None, a), (None, "lonely words that nobody else has here"), (7, None), (8, "")]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 3, 1), (1, 3, 1), (None, 2, 1), (None, 3, None), (7, 0, 7), (8, 0, 8)], key=str)


def test_one_of_each_group_stays(docs_of, corpus):
    kept = sorted(r["doc_id"] for r in jaccard.without_duplicates(docs_of(corpus)).collect())
    assert kept == sorted({c for _, _, c in brute(corpus)})


def test_empty_table(docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    assert jaccard.without_duplicates(docs_of([])).count() == 0


def test_level_never_rules_out_a_link():
    """Sets that meet the threshold share l of their l-prefixes for every l, so no level may be 0."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(20, 200))
        universe = np.sort(rng.choice(10_000, 2 * n, replace=False))
        x = np.sort(rng.choice(universe, n, replace=False))
        drop = int(n * 0.1)
        y = np.sort(np.concatenate([rng.choice(x, n - drop, replace=False), 10_001 + np.arange(drop)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            places = np.flatnonzero(np.isin(x, y))
            longest = jaccard.one_prefix(n) + jaccard.longest_level(n) - 1
            assert jaccard.adaptive_level(n, places[places < longest], np.full((places < longest).sum(), 2)) > 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (30, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_bit_table_holds_every_id(spark):
    ids = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    table = jaccard._filter_of(spark.createDataFrame([(int(i),) for i in ids], "doc long").repartition(12))
    assert len(table) == 1 << jaccard.FILTER_BITS and table[jaccard._bit(ids)].all() and table.sum() == len(np.unique(jaccard._bit(ids)))
    assert not jaccard._filter_of(spark.createDataFrame([], "doc long")).any()
