import random
import re

import pytest

from siftmark.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.append((doc, len(w), len(hit), ",".join(sorted(map(str, found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    words = ["alpha", "béta", "g4", "delta", "Über", "e", "zeta", "eta"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 9, 13, 14, 40])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(words_of(t)) > 2] + [(90, None), (91, "..."), (92, items[-1][1]), (10, "rare single"), (11, "unique")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, ", ".join(text)))
    docs += [(100, None), (101, ""), (102, docs[3][1]), (3, docs[3][1]), (None, items[0][1]), (103, "Rare. SINGLE"), (104, "unique " * 40)]
    return docs, items


def test_same_as_brute_force(spark, docs_of, case):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs_of(docs), benchmark).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got), key=str) == brute(docs, items)


def test_windows_too_many_to_broadcast(spark, docs_of, case, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    test_same_as_brute_force(spark, docs_of, case)


def test_clean_documents_stay_whole(spark, docs_of, case):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.decontaminate(docs_of(docs), benchmark)
    assert kept.columns == docs_of(docs).columns
    clean = sorted((str(i), str(t)) for (i, t) in docs if not brute([(i, t)], items)[0][4])
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == clean


def test_empty_tables(spark, docs_of, case):
    nothing = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(docs_of(case[0]), nothing).collect()
    assert len(got) == len(case[0]) and not any(r["n_hit"] or r["contaminated"] for r in got)
    assert decontamination.contamination(docs_of([]), nothing).count() == 0


def test_runs_without_python(spark, docs_of, case):
    docs, items = case
    found = decontamination.contamination(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
