import re

import numpy as np
import pytest

from siftmark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % step == 0:
            out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    vectors = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 24))).astype(np.float32)
    vectors[200:420] = vectors[0]  # one very common vector
    return [(i, v) for i, v in enumerate(vectors)]


def test_recall_scores_and_ties(spark, cloud):
    vectors = table(spark, cloud)
    got = {}
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_size=250).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(cloud, 10, 20)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        found = [(s, i) for _, s, i in rows]
        assert found == sorted(found) and q not in [i for _, i in found]
        exact = {i: np.sqrt(((cloud[q][1].astype(float) - cloud[i][1].astype(float)) ** 2).sum()) for _, i in found}
        assert all(abs(exact[i] - s) < 1e-12 for s, i in found)
        hits += len({i for _, i in found} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.95


def test_rows_that_take_no_part(spark):
    rows = [(0, [1, 0]), (1, [1, 1]), (2, None), (3, []), (4, [0, 0]), (5, [None, 1]), (6, [float("nan"), 1]), (7, [float("inf"), 1]), (8, [1, 2, 3]), (None, [1, 0]), (20, [2, 0]), (40, [1, 0]), (40, [1, 0])]
    vectors = table(spark, rows)
    got = sorted(tuple(r) for r in neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect())
    want = [(0, 1, 40, 0.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 40, 1.0), (20, 3, 1, 2**0.5), (40, 1, 0, 0.0), (40, 2, 1, 1.0), (40, 3, 20, 1.0)]
    assert got == want


def test_empty_table(spark):
    vectors = table(spark, [])
    assert neighbours.nearest(vectors, vectors).count() == 0


def test_graph_layers_are_flat(cloud):
    graph = neighbours.Graph.build(np.array([v for _, v in cloud[:200]]))
    assert all(layer.dtype == np.int32 and layer.ndim == 2 for layer in graph.layers)
    assert (graph.layers[0] >= 0).any(axis=1).all()


def test_the_plan_does_not_grow_with_the_shards(spark, cloud):
    vectors = table(spark, cloud)
    found = [neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_size=n) for n in (400, 20)]
    plans = [re.sub(r"#\d+L?|\d+|[0-9a-f]{32}", "", d._jdf.queryExecution().optimizedPlan().toString()) for d in found]
    assert plans[0] == plans[1]
    few, many = ({(r["query_id"], r["rank"]): r["score"] for r in d.collect()} for d in found)
    assert set(few) == set(many) and sum(abs(few[r] - many[r]) < 1e-12 for r in few) >= 0.95 * len(few)


def test_each_graph_is_sent_once(spark, cloud, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 5)
    vectors = table(spark, cloud)
    whole = neighbours._search
    seen = spark.sparkContext.accumulator(0)

    def counted(k, beam):
        def run(batches):
            def passed():
                for batch in batches:
                    seen.add(batch.num_rows - batch.column("vectors").null_count)
                    yield batch

            yield from whole(k, beam)(passed())

        return run

    monkeypatch.setattr(neighbours, "_search", counted)
    rows = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_size=100).collect()
    assert len(rows) == 450 and 5 <= seen.value <= 9  # 681 distinct vectors in 7 shards, 45 queries in 9 blocks
