import random

import pytest

import corpus_pipeline
from siftmark.llm import decontamination, jaccard, pii, toxicity
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_components


@pytest.fixture(scope="module")
def sf_dir(spark, docs_of, tmp_path_factory):
    """A small folder of tables: toxic rows, near copies, benchmark passages and personal data are planted."""
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    item = [rng.choice(words) for _ in range(30)]
    docs, labels = [], []
    for i in range(400):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 90))], int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            text.insert(rng.randint(0, len(text)), "grumblefist")
        if i % 17 == 3:
            text[5:5] = item
        if i % 11 == 2:
            text.append("call +1 (222) 555-1111 or a.b@example.org today")
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    docs += [(400 + i, docs[i][1]) for i in range(20)] + [(430 + i, docs[40 + i][1] + " tail") for i in range(20)] + [(500, None), (501, ""), (None, "no id here")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs_of(docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns
    assert rows_of(clean) == sorted(((i, t) for i, t in rows_of(docs) if "grumblefist" not in (t or "")), key=str)

    before = rows_of(clean)
    single = stages["near_duplicates"](spark, clean, sf_dir)
    named = [(i, t) for i, t in before if i is not None]
    kept = {c for _, _, c in brute_components(named)}
    assert single.columns == columns and rows_of(single) == sorted(((i, t) for i, t in before if i is None or i in kept), key=str)

    before = rows_of(single)
    fair = stages["decontamination"](spark, single, sf_dir)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    hit = {r[0] for r in brute_hits(before, [(item["item_id"], item["text"])]) if r[4]}
    assert fair.columns == columns and rows_of(fair) == sorted(((i, t) for i, t in before if i not in hit), key=str) and hit

    hidden = {r["doc_id"]: r for r in stages["personal_data"](spark, fair, sf_dir).collect()}
    for i, text in rows_of(fair):
        want = None if text is None else text.replace("+1 (222) 555-1111", "[phone]").replace("a.b@example.org", "[email]")
        assert hidden[i]["text"] == want and hidden[i]["n_chars"] == (None if want is None else len(want))

    pieces = stages["packing"](spark, fair, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows_of(fair)}


def test_run_equals_the_stages(spark, sf_dir):
    got = sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=str)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    last = corpus_pipeline.STAGES[-1][1](spark, docs.coalesce(1), sf_dir)
    assert {g[0] for g in got} == {r["doc_id"] for r in last.collect()} and got


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_each_stage_calls_its_operator():
    names = {toxicity: "toxicity.score", jaccard: "jaccard.without_duplicates", decontamination: "decontamination.decontaminate", pii: "pii.redacted"}
    source = open(corpus_pipeline.__file__, encoding="utf-8").read()
    assert all(call in source for call in names.values()) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


# Names that operators use inside, and some that need quoting.
CLASHING = [
    "_id", "_key", "_n", "_all", "_text_key", "_blob", "_found_blob", "_score", "_before", "_base", "_spans", "_found", "_w", "_at", "_toxic",
    "component_id", "n_shingles", "blob", "kind", "spans", "items", "n", "doc", "window", "length", "word", "kept column 3", "a.b", "kept",
]


def test_extra_columns_of_any_name_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 or doc_id is null")
    wide = docs.selectExpr("*", *[f"concat('{name}', coalesce(cast(doc_id as string), '')) as `{name}`" for name in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, wide, sf_dir), stage(spark, docs, sf_dir)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == rows_of(want), name
        for r in rows:
            assert all(r[c] == f"{c}{'' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir).count() >= wide.count()


def test_secrets_keep_extra_columns(spark, sf_dir):
    from siftmark.llm.secrets import secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 20").selectExpr("*", "doc_id as _all", "doc_id as _blob", "'mine' as _spans")
    got = secrets(docs)
    assert got.columns == [*docs.columns[:-1], "_base", "_spans"]
    assert all(r["_all"] == r["_blob"] == r["doc_id"] for r in got.collect())
