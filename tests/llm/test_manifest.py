import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siftmark.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place string, nodes long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    """The contract, read plainly: levels of pairs, siblings by index, folded again from the found leaf."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    built = {x: levels_of([leaf(r) for r in t]) for x, t in trees.items()}
    whole = levels_of([built[x][-1][0] for x in langs])
    out = []
    for number, x in enumerate(langs):
        for i, row in enumerate(trees[x]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            found, siblings = leaf(row, 1 if hit else 0), []
            for levels, place in ((built[x], i), (whole, number)):
                for level in levels[:-1]:
                    other = place ^ 1
                    if other >= len(level):
                        found = sha(found)
                    else:
                        siblings.append(level[other])
                        found = sha(level[other], found) if place & 1 else sha(found, level[other])
                    place >>= 1
            root = whole[-1][0]
            out.append((row[0], leaf(row), built[x][-1][0], root, sha(*siblings), found, found == root))
    return sorted(out, key=str)


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = manifest.manifest(docs, F.when(hit, manifest.leaf_digest(n_chars=F.col("n_chars") + 1)), **how)
    return got, sorted((tuple(r)[:7] for r in got.collect()), key=str)


ODD = [
    (1, "s", "en", 3, "abc", "x", 9),
    (2, None, None, None, None, None, None),
    (None, "s", "en", 0, "", "x", 1),
    (None, "s", "en", 0, "", "x", 1),
    (3, "s", "en", 3, "abc", "x", 9),
    (3, "s", "en", 3, "other", "x", 9),
    (3, "s", "en", 3, "abc", "x", 9),
    (4, "ß", "ß", 1, "ß" * 40_000, "x", 0),
    (5, "s", "zz", 1, "lone", "x", 0),
]


@pytest.mark.parametrize("size", [4, 4096])
def test_against_plain_trees(spark, size):
    rows = ODD + [(i, "s", ("en", "fr", None)[i % 3 if i < 40 else 0], i, f"text {i}", "p", i) for i in range(10, 75)]
    got, result = found(spark, rows, size=size)
    assert result == brute(rows)
    root = result[0][3]
    for row in got.collect():
        assert manifest.fold(row["leaf"], row["witness"]) == root
    assert {r[6] for r in result} == {True, False}


def test_one_leaf_and_none(spark):
    one = [(7, "s", "en", 2, "ab", "x", 1)]
    _, result = found(spark, one)
    assert result == brute(one) and result[0][1] == result[0][2] == result[0][3]
    assert found(spark, [])[1] == []


def test_appender_of_every_size():
    for size in range(1, 40):
        leaves = [sha(str(i)) for i in range(size)]
        for height in {(size - 1).bit_length(), 6}:
            tree = manifest.Appender(size, height)
            for digest in leaves:
                tree.append(digest)
            root = tree.root()
            assert all(manifest.fold(d, tree.witness(i)) == root for i, d in enumerate(leaves))
        assert height != (size - 1).bit_length() or root == levels_of(leaves)[-1][0]
