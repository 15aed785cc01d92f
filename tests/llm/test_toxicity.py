import random
import zlib

import numpy as np
import pytest

from siftmark.llm import toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["grumblefist", "snarkwad", "blödmaul"]
    docs, labels = [], []
    for i in range(900):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(5, 120))], int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) * toxic):
            text.insert(rng.randint(0, len(text)), rng.choice(bad) + rng.choice(["", "s", ".", "en"]))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark, docs_of, corpus):
    docs, labels = corpus
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(docs_of(docs), table).withColumn("held", toxicity.held_out()).collect()
    truth = dict(labels)
    held = [r for r in scored if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum((r["_score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held)
    assert right / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, docs_of, corpus):
    docs, labels = corpus
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = []
    for rows in (labels, turned):
        got = toxicity.score(docs_of(docs[:200]), spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        scores.append({r["doc_id"]: r["_score"] for r in got})
    assert scores[0] == scores[1]


def test_buckets_by_plain_loop():
    text = " Ab çd🙂 "
    def one(codes):
        h = len(codes) * 0x9E3779B1 % 2**32
        for c in codes:
            h = (h ^ c) * 0x85EBCA6B % 2**32
            h ^= h >> 15
        return (h * 0xC2B2AE35 % 2**32) >> (32 - toxicity.BITS)
    codes = [ord(c) for c in f" {text.lower()} "]
    want = [one(codes[i : i + n]) for n in toxicity.ORDERS for i in range(len(codes) - n + 1)]
    assert toxicity.buckets(text).tolist() == want
    assert len(toxicity.buckets(None)) == 0 and len(toxicity.buckets("")) == 0


def test_nulls_repeats_and_missing_labels(spark, docs_of, corpus):
    docs = [(1, None), (2, ""), (None, "snarkwad here"), (3, "x" * 50_000), (3, "x")]
    labels = [(1, None), (None, 1), (3, 1), (3, 0), (99, 1)]
    got = toxicity.score(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 5 and all(0 <= r["_score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["_score"] < 1e-6 for r in toxicity.score(docs_of(docs), none).collect())
    assert toxicity.score(docs_of([]), none).count() == 0


def test_sample_is_bounded(spark, docs_of, corpus):
    docs, labels = corpus
    rows = toxicity.labelled_rows(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), 50)
    assert rows.count() == 50


def test_ratios(spark, docs_of):
    docs = [(i, "zzzz" if i % 2 else "qqqq") for i in range(40)]
    rows = toxicity.labelled_rows(docs_of(docs), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    ratios, n1, n0 = toxicity.log_count_ratios(rows)
    want = np.log((n1 + 0.5) / (n1 + 1)) - np.log(0.5 / (n0 + 1))
    assert np.isclose(ratios[toxicity.buckets("zzzz")[1]], want, rtol=1e-5)
