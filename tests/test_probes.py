"""The fitted and the permuted probe against plain numpy."""

import hashlib

import numpy as np
import pytest

from siftmark.operators import logistic, probes


def ranks_auroc(y, s):
    wins = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0])
    return wins / ((y == 1).sum() * (y == 0).sum())


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(8)
    out = {}
    for name, n, shift in (("a", 60, 0.8), ("b", 45, 0.0), (None, 30, 0.3)):
        y = (rng.random(n) < 0.4).astype(int)
        out[name] = (np.arange(n) + 100 * len(out), rng.normal(size=(n, 4)) * [1, 10, 0.1, 1] + shift * y[:, None], y)
    return out


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(name, int(i), [float(v) for v in v_], int(l)) for name, (ids, x, y) in groups.items() if name for i, v_, l in zip(ids, x, y)]
    return spark.createDataFrame(rows, "grp string, id long, f array<double>, label int").repartition(5)


def plain_logistic(ids, x, y, folds, repeats, c=0.5):
    """Gradient descent with halving steps, one fit after the other."""
    values = []
    for repeat in range(repeats):
        fold = np.empty(len(y), int)
        for label in (0, 1):
            own = np.flatnonzero(y == label)
            fold[sorted(own, key=lambda i: md5(f"{repeat}:fold:{ids[i]}"))] = np.arange(len(own)) % folds
        decision = np.empty(len(y))
        for k in range(folds):
            train = fold != k
            mean, deviation = x[train].mean(0), x[train].std(0) + 1e-9
            a = np.hstack([np.ones((len(x), 1)), (x - mean) / deviation])
            w, penalty = np.zeros(a.shape[1]), np.r_[0.0, np.ones(x.shape[1])]

            def gradient(w):
                return c * a[train].T @ (1 / (1 + np.exp(-a[train] @ w)) - y[train]) + penalty * w

            step = 1 / (c * 0.25 * np.linalg.norm(a[train], 2) ** 2 + 1)
            for _ in range(20_000):
                g = gradient(w)
                if np.abs(g).max() < 1e-11:
                    break
                w -= step * g
            decision[~train] = (a @ w)[~train]
        values.append(ranks_auroc(y, decision))
    return float(np.mean(values))


def test_logistic_probe_of_all_groups_at_once(spark, groups, table):
    got = {r["grp"]: r["auroc"] for r in logistic.logistic_probe(table, ["grp"], "id", "f", folds=3, repeats=2).collect()}
    for name in ("a", "b"):
        assert got[name] == pytest.approx(plain_logistic(*groups[name], 3, 2), abs=1e-9)


def test_logistic_probe_of_one_class_and_of_no_rows(spark, table):
    assert logistic.logistic_probe(table.where("label = 1"), ["grp"], "id", "f", folds=3, repeats=2).first()["auroc"] is None
    assert logistic.logistic_probe(table.where("false"), ["grp"], "id", "f").collect() == []


def plain_scores(z, y):
    s1, s0, n1, n0 = z[y == 1].sum(0), z[y == 0].sum(0), (y == 1).sum(), (y == 0).sum()
    own = y[:, None]
    return np.linalg.norm(z - (s0 - z * (1 - own)) / (n0 - (1 - own)), axis=1) - np.linalg.norm(z - (s1 - z * own) / (n1 - own), axis=1)


def test_every_permutation_is_counted(spark, groups, table):
    got = {r["grp"]: r for r in probes.permutation_test(table, ["grp"], "id", "f", n_perm=50).collect()}
    for name in ("a", "b"):
        ids, x, y = groups[name]
        z = (x - x.mean(0)) / (x.std(0) + 1e-9)
        real, shuffled = ranks_auroc(y, plain_scores(z, y)), []
        for perm in range(50):
            label = np.zeros(len(y), int)
            label[sorted(range(len(y)), key=lambda i: md5(f"{perm}:permute:{ids[i]}"))[: y.sum()]] = 1
            shuffled.append(ranks_auroc(label, plain_scores(z, label)))
        assert got[name]["probe_auroc"] == pytest.approx(real, abs=1e-9)
        assert got[name]["p_high"] == pytest.approx((1 + sum(v >= real for v in shuffled)) / 51)
        assert got[name]["p_low"] == pytest.approx((1 + sum(v <= real for v in shuffled)) / 51)
