"""Round trips: a given table is written in a file format and read back by the scan that declares it.

Files go below the shared scratch folder. Each SQL twin states the rows on the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.plans import bindings as B
from siftmark.plans.catalogue import query
from siftmark.plans.headline import rounded
from siftmark.plans.sql_tables import LATENCY, SCORES, r6
from siftmark.session import scratch_dir
from siftmark.sources import scans, schemas, sinks


@query(
    "folder_inventory",
    """SELECT DISTINCT 'cat' || l_linestatus AS category, CASE l_returnflag WHEN 'A' THEN 'train' ELSE 'test' END AS folder,
      CASE l_returnflag WHEN 'R' THEN 'scratch' ELSE 'good' END AS type, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS label FROM lineitem""",
)
def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category/split/type tree of files, listed without reading them."""
    root, rows = scratch_dir(spark, "tree"), B.table(spark, sf_dir, "lineitem")
    for status in ("O", "F"):  # fixed values: the flags of the table
        for flag, place in (("A", "train/good"), ("N", "test/good"), ("R", "test/scratch")):
            mine = rows.where((F.col("l_linestatus") == status) & (F.col("l_returnflag") == flag)).select(F.col("l_orderkey").cast("string").alias("value"))
            mine.limit(1).write.text(f"{root}/cat{status}/{place}")
    found = scans.folder_inventory(spark, root, "*.txt").where("path like '%.txt'")
    return found.select("category", "folder", "type", "label").distinct()


@query(
    "split_csv_scan",
    """SELECT lang AS category, 'train' AS split, source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS path, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS label
    FROM documents WHERE lang = 'en' AND doc_id % 3 > 0""",
)
def split_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "split-csv")
    rows = B.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("object"),
        F.when(F.col("doc_id") % 3 > 0, "train").otherwise("test").alias("split"),
        F.when(F.col("n_chars") > 2000, "anomaly").otherwise("normal").alias("label"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
    )
    sinks.write_csv(rows, path)
    return scans.split_csv(spark, path, category="en", split="train")


@query("subset_csv_scan", "SELECT lang AS category, CAST(doc_id AS VARCHAR) AS path, n_chars FROM documents WHERE source IN ('src1', 'src7')")
def subset_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "subset-csv")
    items = B.table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("path"), "n_chars", "source")
    listed = items.where(F.col("source").isin("src1", "src7")).select("category", F.col("source").alias("session"), "path")
    sinks.write_csv(listed.unionByName(listed), path)
    return scans.subset_csv(spark, path, items.drop("source"))


@query(
    "score_csv_scan",
    f"""WITH {SCORES} SELECT dataset, category, seed, split, path, label, {r6('two_view')} AS two_view, CASE WHEN line_no = 3 THEN NULL ELSE {r6('two_view')} END AS score, {r6('pos_weight')} AS pos_weight FROM scores
    WHERE NOT (line_no = 3)
    UNION ALL SELECT dataset, category, seed, split, path, label, NULL, NULL, {r6('pos_weight')} FROM scores WHERE line_no = 3""",
)
def score_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "score-csv")
    scores = B.two_view_scores(spark, sf_dir)
    two_view = F.when(F.col("line_no") == 3, F.lit(float("nan"))).otherwise(F.col("score"))
    rows = scores.select("dataset", "category", "seed", "split", F.col("path").alias("file"), "label", two_view.alias("score_two_view"), F.lit(0.0).alias("score_single"), "pos_weight")
    sinks.write_csv(rows, path)
    read = scans.score_csv(spark, path)
    whole = read.withColumn("two_view", F.when(~F.isnan("score_two_view"), F.col("score_two_view")))
    return rounded(whole.select("dataset", "category", "seed", "split", "path", "label", "two_view", "score", "pos_weight"), "two_view", "score", "pos_weight")


@query(
    "timing_csv_scan",
    f"""WITH {LATENCY} SELECT model, image_size, precision, {r6('ms')} AS ms_bs1, CASE WHEN image_size > 200 THEN {r6('ms')} END AS peak_mem_mb FROM latency WHERE status = 'ok'""",
)
def timing_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one schema, read together; failed rows are left out."""
    rows = B.latency_rows(spark, sf_dir)
    names = [c.split()[0] for c in schemas.TIMING_CSV.split(", ")]
    given = {
        "model": F.col("model"), "image_size": F.col("image_size"), "precision": F.col("precision"), "status": F.col("status"), "ms_bs1": F.col("ms"),
        "peak_mem_mb": F.when(F.col("image_size") > 200, F.col("ms")).otherwise(F.lit(float("nan"))),
    }
    paths = []
    for precision in ("fp32", "fp16"):
        paths.append(scratch_dir(spark, f"timing-{precision}"))
        mine = rows.where(F.col("precision") == precision)
        sinks.write_csv(mine.select(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names]), paths[-1])
    read = scans.timing_csv(spark, paths).select("model", "image_size", "precision", "ms_bs1", "peak_mem_mb")
    return rounded(read, "ms_bs1", "peak_mem_mb")


@query("json_document_scan", "SELECT n_name AS name, n_regionkey AS region, count(*) AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def json_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per nation and file."""
    path = scratch_dir(spark, "documents")
    nation, supplier = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "supplier")
    counts = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.count(F.lit(1)).alias("suppliers"))
    rows = counts.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), "suppliers")).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return scans.json_document(spark, path, "name string, region long, suppliers long").select("name", "region", "suppliers")


@query("summary_sink", "SELECT s_suppkey AS best_epoch, s_nationkey::INTEGER AS epochs_ran, round(s_acctbal, 2) AS best_val_score, s_acctbal < 0 AS collapsed FROM supplier")
def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "summaries")
    rows = B.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("best_epoch"), F.col("s_nationkey").alias("epochs_ran"), F.round("s_acctbal", 2).alias("best_val_score"), (F.col("s_acctbal") < 0).alias("collapsed")
    )
    sinks.write_summary(rows, path)
    read = scans.json_lines(spark, path, schemas.SUMMARY)
    return read.select(F.col("best_epoch").cast("long").alias("best_epoch"), "epochs_ran", "best_val_score", "collapsed")


@query(
    "stage_log",
    "SELECT 'run' || CAST(o_orderstatus AS VARCHAR) AS run, o_orderpriority AS category, 'dataset' AS stage, count(*) AS n, max(year(o_orderdate))::INTEGER AS seed FROM orders GROUP BY ALL",
)
def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two stages appended per run, category and stream; one stage is read back, partitions included."""
    path = scratch_dir(spark, "stages")
    orders = B.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run"), "o_orderstatus").alias("run"), F.col("o_orderpriority").alias("category"), F.lit("dataset").alias("stage"), F.year("o_orderdate").alias("seed")
    )
    recorder = sinks.FolderRecorder(path)
    recorder.record("stages", orders)
    recorder.record("other", orders.withColumn("stage", F.lit("other")))
    read = scans.stage_rows(spark, path, "dataset")
    return read.groupBy("run", "category", "stage").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))


@query("newest_file", "SELECT 'n=' || CAST(max(n_nationkey) AS VARCHAR) AS folder, true AS present FROM (SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 10 AND 20) UNION ALL SELECT NULL, false")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last path of a name below a root, and NULL below a root without one."""
    path = scratch_dir(spark, "newest")
    nations = B.table(spark, sf_dir, "nation").where("n_nationkey between 10 and 20")
    nations.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("value")).repartition("n").write.partitionBy("n").text(path)
    found = scans.newest_file(spark, path, "part-*.txt").unionByName(scans.newest_file(spark, path, "absent.json"))
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("path").isNotNull().alias("present"))


SCORE_FILES = f"""SELECT dataset, 'b' || CAST(seed AS VARCHAR) AS backbone, category, split, path, label, {r6('two_view')} AS score,
  dataset || '/b' || CAST(seed AS VARCHAR) || '/' || category AS key FROM scores WHERE dataset = 'O' AND split = 'test'"""


@query("score_files", f"WITH {SCORES} {SCORE_FILES}")
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores partitioned by group; the filter on two partition columns prunes folders."""
    path = scratch_dir(spark, "score-files")
    rows = B.two_view_scores(spark, sf_dir).withColumn("backbone", F.concat(F.lit("b"), F.col("seed").cast("string")))
    sinks.write_scores(rows.select("dataset", "backbone", "category", "split", "path", "label", "score"), path)
    read = scans.score_files(spark, path).where("dataset = 'O' and split = 'test'")
    return rounded(read.select("dataset", "backbone", "category", "split", "path", "label", "score", "key"), "score")


@query(
    "view_score_files",
    f"""WITH {SCORES} SELECT dataset, category, split, path_tail AS path, label, {r6('v0')} AS first, {r6('v3')} AS last FROM
      (SELECT *, array_to_string(split(path, '/')[-3:], '/') AS path_tail FROM scores)""",
)
def view_score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with an array of views per row, read back by a schema that declares it."""
    path = scratch_dir(spark, "view-scores")
    rows = B.scores(spark, sf_dir).withColumn("backbone", F.lit("b"))
    sinks.write_scores(rows.select("dataset", "backbone", "category", "split", "path", "label", "views"), path)
    read = scans.view_score_files(spark, path)
    return rounded(read.select("dataset", "category", "split", "path", "label", F.get("views", 0).alias("first"), F.get("views", 3).alias("last")), "first", "last")


@query("epoch_score_files", f"WITH {SCORES} SELECT dataset AS run, seed AS epoch, count(*) AS n, {r6('sum(two_view)')} AS total FROM scores GROUP BY ALL")
def epoch_score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of one long table, by run and epoch."""
    path = scratch_dir(spark, "epoch-scores")
    rows = B.two_view_scores(spark, sf_dir).select(F.col("dataset").alias("run"), F.col("seed").alias("epoch"), "path", "score")
    for part in (rows.where("epoch < 1995"), rows.where("epoch >= 1995")):
        sinks.write_epoch_scores(part, path)
    read = spark.read.parquet(path).groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    return rounded(read, "total")


@query("markdown_report", "SELECT '| ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS value FROM nation UNION ALL SELECT '| n_name | n_regionkey |' UNION ALL SELECT '|---|---|'")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "markdown")
    sinks.write_markdown(B.table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), path, ["n_name"])
    return spark.read.text(path)


@query(
    "ordered_report",
    """SELECT '| ' || l_suppkey || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) || ' |' AS value FROM lineitem GROUP BY l_suppkey
    UNION ALL SELECT '| l_suppkey | n | quantity |' UNION ALL SELECT '|---|---|---|'""",
)
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report line per supplier, in files dealt by ranges of the order."""
    path = scratch_dir(spark, "report")
    lines = B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )
    sinks.write_markdown(lines, path, ["l_suppkey"])
    return spark.read.text(path)
