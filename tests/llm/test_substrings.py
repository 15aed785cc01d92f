import random

import numpy as np
import pytest

from siftmark.llm import induced, substrings


def brute(docs):
    """Windows by dictionary, in order of id; equal rows of (id, text) are one document."""
    seen, marks = set(), {}
    order = sorted({(i, (t or "").encode()) for i, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0))
    for key in order:
        data, mask = key[1], bytearray(len(key[1]))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(window)
        marks[key] = mask
    out = []
    for i, t in docs:
        data, mask = (t or "").encode(), marks[i, (t or "").encode()]
        spans, p = [], 0
        while p < len(data):
            if mask[p]:
                q = p
                while q < len(data) and mask[q]:
                    q += 1
                spans.append((p, q))
                p = q
            p += 1
        out.append((i, len(data), bytes(b for b, m in zip(data, mask) if not m), spans))
    return sorted(out, key=str)


def kept(spark, docs, **how):
    table = spark.createDataFrame([(i, t, 1, "x", 5) for i, t in docs], "doc_id long, text string, doc int, version string, marks int").repartition(4)
    got = substrings.without_repeats(table, **how).collect()
    return sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), [(s["start"], s["stop"]) for s in r["spans"]]) for r in got), key=str)


def passages(seed):
    rng = random.Random(seed)

    def prose(n):
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(n))

    common = [prose(rng.randint(15, 60)) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [prose(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(common)
            a = rng.randint(0, len(text) // 2)
            parts += [text[a : rng.randint(a, len(text))] if rng.random() < 0.6 else text, prose(rng.randint(0, 20))]
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(12)] + [(220, docs[5][1] + "!"), (221, "x" + docs[6][1])]
    docs += [(230, "ab" * 400), (231, "ab" * 60 + "c"), (232, "a" * 1000), (233, "Straße " * 60), (234, "日本語" * 50), (235, "z" * 99), (236, "z" * 100), (237, "z" * 101)]
    return docs


@pytest.mark.parametrize("heavy_rows", [20_000, 3])
def test_against_all_windows(spark, heavy_rows):
    docs = passages(4)
    want = brute(docs)
    assert kept(spark, docs, heavy_rows=heavy_rows) == want and sum(bool(r[3]) for r in want) > 30


def test_odd_rows(spark):
    text = "".join(t for _, t in passages(9)[:8])
    docs = [(1, None), (2, ""), (3, "short"), (4, text), (4, text), (5, text + "tail"), (6, "q" * 300_000)]
    assert kept(spark, docs) == brute(docs) and len(text) > 300
    assert kept(spark, []) == []
    # without id, the documents come first, whichever of them is the earlier one
    got = kept(spark, [(0, text), (None, text)])
    assert [r[3] == [] for r in got if r[0] == 0] == [False]


def test_small_shards_and_chunks(spark, monkeypatch):
    docs = passages(11)
    data = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for _, t in docs])
    whole = substrings.stretches(data, ends)
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    parts = substrings.stretches(data, ends)
    windows = [np.concatenate([np.arange(s, s + n) for s, n in zip(x[2], x[3])]) for x in (whole, parts)]
    assert (windows[0] == windows[1]).all() and (np.repeat(whole[0], whole[3]) == np.repeat(parts[0], parts[3])).all()


def suffixes(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < induced.MOST and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        shared.append(n)
    return order, shared


def test_induced_order_and_shared_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 20, 200])
        text = [rng.randint(1, letters) for _ in range(rng.choice([1, 2, 5, 30, 200, 400]))]
        text += text[: rng.choice([0, len(text) // 2])] + [2] * rng.choice([0, 0, 250]) + [0]
        order, shared = induced.suffixes_with_shared(np.array(text, np.uint16), max(text) + 1)
        assert (order.tolist(), shared.tolist()) == suffixes(text)


def test_repeats_do_not_reach_over_separators():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(130)) for _ in range(40)]
    texts += [rng.choice(texts)[rng.randint(0, 40) :] for _ in range(200)]
    zeros = np.zeros(len(texts), np.int64)
    row, first, last = substrings.repeats(texts, np.arange(len(texts)), zeros, zeros)
    seen, want = set(), set()
    for i, text in enumerate(texts):
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                want.add((i, p))
            seen.add(text[p : p + 100])
    assert {(int(r), p) for r, a, b in zip(row, first, last) for p in range(a, b + 1)} == want
