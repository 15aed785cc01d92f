"""The registered queries of this folder: each applies one operator to its whole table.

A query keeps to its contract's digest columns; the operators themselves return texts, spans and pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm import chains, chat, decontamination, html, importance, jaccard, manifest, neighbours, packing, pii, secrets, substrings, toxicity
from siftmark.llm.common import table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL_TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            SQL_TWINS[name] = sql
        return build

    return register


def span_text(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op1_personal_data")
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[span_count("_base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(span_text("_base"), 256).alias("base_sha256"),
        span_text("_spans").alias("spans"),
    )


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w[i : i + 12] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT r, i, n, w[i : i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_TEXT = "</s>[INST] ok [/INST]"


@query("op6_chat")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = spark.createDataFrame([(-1, 0, "user", OP6_TEXT), (-1, 1, "assistant", OP6_TEXT)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(stated)
    return chat.read_back(chat.formatted(conversations))


@query("op7_fuzzy_passages")
def op7_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_main").alias("text"), F.length("_main").cast("long").alias("n_chars"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[span_count("_base", k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(span_text("_base"), 256).alias("base_sha256"),
        span_text("_spans").alias("spans"),
    )


@query("op11_repeated_substrings")
def op11_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# CRC-32 in SQL: a table of 256 remainders, then one step for each byte of the hexadecimal form.
CRC_TABLE = """tab(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM tab WHERE k = 8)"""


def crc_sql(blob: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(hex({blob}), 2 * j + 1, 2) AS BIGINT) for j in range(octet_length({blob}))]),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, {{crc}} % 7 = 0 AS hit FROM documents, crc),
f AS (SELECT doc_id, lang, n_chars, coalesce(hit, false) AS hit,
    {{doc_id}} || {{source}} || {{lang}} AS head, {{text}} AS tail FROM d),
leaves AS (SELECT *, sha256(head || {{n_chars}} || tail) AS leaf, CASE WHEN hit THEN sha256(head || {{n_chars_1}} || tail) ELSE leaf END AS held,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM f),
nodes AS (SELECT lang, 0 AS l, p, leaf AS h, n FROM leaves UNION ALL
    SELECT lang, l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, l, p // 2, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS l, p, h, n FROM subroots UNION ALL
    SELECT l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY l, p // 2, n),
ids AS (SELECT row_number() OVER () AS r, * FROM leaves),
low AS (SELECT r, string_agg(s.h, '' ORDER BY s.l) AS proof FROM ids i JOIN nodes s ON s.lang IS NOT DISTINCT FROM i.lang AND s.p = xor(i.p >> s.l, 1) GROUP BY r),
high AS (SELECT u.lang, string_agg(s.h, '' ORDER BY s.l) AS proof FROM subroots u JOIN tops s ON s.p = xor(u.p >> s.l, 1) GROUP BY u.lang),
up AS (SELECT r, lang, 0 AS l, p, n, held AS h FROM ids UNION ALL
    SELECT r, u.lang, u.l + 1, u.p // 2, (u.n + 1) // 2, CASE WHEN s.h IS NULL THEN sha256(u.h) WHEN u.p % 2 = 0 THEN sha256(u.h || s.h) ELSE sha256(s.h || u.h) END
    FROM up u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.l = u.l AND s.p = xor(u.p, 1) WHERE u.n > 1),
over AS (SELECT r, 0 AS l, t.p, t.n, up.h FROM up JOIN subroots t ON t.lang IS NOT DISTINCT FROM up.lang WHERE up.n = 1 UNION ALL
    SELECT r, u.l + 1, u.p // 2, (u.n + 1) // 2, CASE WHEN s.h IS NULL THEN sha256(u.h) WHEN u.p % 2 = 0 THEN sha256(u.h || s.h) ELSE sha256(s.h || u.h) END
    FROM over u LEFT JOIN tops s ON s.l = u.l AND s.p = xor(u.p, 1) WHERE u.n > 1),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT i.doc_id, leaf, t.h AS subroot, root, sha256(coalesce(low.proof, '') || coalesce(high.proof, '')) AS proof_sha256, over.h AS folded_root, over.h = root AS verified
FROM ids i JOIN subroots t ON t.lang IS NOT DISTINCT FROM i.lang JOIN over ON over.r = i.r AND over.n = 1 LEFT JOIN low ON low.r = i.r
    LEFT JOIN high ON high.lang IS NOT DISTINCT FROM i.lang, root
"""


def field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


OP12_SQL = OP12_SQL.format(
    crc=crc_sql("CAST(CAST(doc_id AS VARCHAR) AS BLOB)"), **{c: field_sql(c) for c in ("doc_id", "source", "lang", "text", "n_chars")}, n_chars_1=field_sql("(n_chars + 1)")
)


@query("op12_manifest", OP12_SQL)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    held = F.when(altered, manifest.leaf_digest(n_chars=F.col("n_chars") + 1))
    found = manifest.manifest(table(spark, sf_dir, "documents").select(*manifest.FIELDS), held)
    return found.drop("witness")


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
words AS (SELECT row_number() OVER () AS r, doc_id, true AS mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (SELECT r, mine, f, count(*) AS n FROM (
    SELECT r, mine, unnest(list_concat(w, list_concat([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]))) AS f FROM words) GROUP BY ALL),
hashed AS (SELECT f, {crc_sql("encode(f)")} % 10000 AS b FROM (SELECT DISTINCT f FROM runs), crc),
held AS (SELECT r, mine, b, sum(n) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT sum(n) FILTER (mine) AS s_all, coalesce(sum(n) FILTER (NOT mine), 0) AS t_all FROM held),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g
    FROM (SELECT b, coalesce(sum(n) FILTER (mine), 0) AS s, coalesce(sum(n) FILTER (NOT mine), 0) AS t FROM held GROUP BY b), totals),
weighed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM held JOIN gain USING (b) WHERE mine GROUP BY r),
scored AS (SELECT r, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN weighed USING (r) WHERE mine),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY fit) AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * fits // 100 THEN place END AS rank FROM placed
"""


@query("op13_importance_resampling", OP13_SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
