import hashlib
import math
import random
import re
import zlib
from collections import Counter

from siftmark.llm import importance


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def buckets_of(text):
    w = words_of(text)
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target):
    """The contract with joined runs, a pattern for the words, and one sorted list."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words_of(text)) >= 20])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(fit[: 5 * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(spark, docs, target):
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, n_words string, _place int, fit int")
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=str)


def test_against_joined_runs(spark):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "Ünder", "x9", "naïve", "日本", "K", "İ", "a_b", "do-re", "tab\tbed", "zero\x00null", "c d"] + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " ,;- "), (None, docs[3][1]), (None, docs[3][1]), (7, docs[7][1]), (8, "other " * 30), (503, "word " * 30_000)]
    target = [" ".join(rng.choice(vocabulary[:60]) for _ in range(40)) for _ in range(10)] + [None, ""]
    got = drawn(spark, docs, target)
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 5


def test_empty_tables(spark):
    assert drawn(spark, [], ["a b c"]) == []
    docs = [(i, "one two three " * 10) for i in range(50)]
    assert drawn(spark, docs, []) == brute(docs, [])


def test_words_are_read_off_bytes():
    text = "".join(map(chr, range(1, 300))) + " É" + "\U0001f600 K"
    joined = " ".join(words_of(text)).encode()
    assert text.encode().translate(importance.TABLE).split() == joined.split()
