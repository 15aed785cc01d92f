"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. A run joins the blobs of its input with the ledger,
which holds a row for every blob and rule version scanned so far, and scans only the pairs that are not in it,
each blob once however many paths hold it. Findings are kept beside the ledger and joined back to all paths.
Only DataFrame functions are used. Offsets come from splitting a text at a pattern: the pieces and the matches
alternate, so their lengths add up to positions.

Defined results: null and empty texts are the empty blob, without findings; equal texts share one scan, and every row, repeated
or without id, gets the findings of its blob; an empty table gives no rows; a new version of a rule scans every blob again
for that rule only, and findings of its earlier versions stop counting; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.llm.common import checkpointed, shielded, text_or_empty
from siftmark.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, the least length, and texts one of which every match holds."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


# The first three kinds in the order of the report, then what the method adds.
RULES = [
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]++(?<=[0-9a-f]{16})", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, (".eyJ",)),
    Rule("vendor", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1, ("gh", "glpat-", "xox", "sk_live_")),
]
BASE = [r.kind for r in RULES[:3]]
SPANS = "array<struct<start:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches; those that are too short are dropped after they were taken."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
    pieces = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("whole"), F.transform(counted, F.length).alias("counted"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        end = start + piece["whole"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(piece["counted"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pieces, zero, step)["out"]
    possible = reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in rule.needs]) if rule.needs else text.rlike(rule.pattern)
    return F.when(possible, found).otherwise(F.array().cast(SPANS))


class Ledger:
    """The folder of scanned (blob, rule, version) rows and of findings; appended to by each scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.seen_path, self.found_path = spark, f"{path}/seen", f"{path}/findings"

    def _table(self, path: str, schema: str) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("append").parquet(path)  # makes the folder at the first run
        return self.spark.read.schema(schema).parquet(path)

    def seen(self) -> DataFrame:
        return self._table(self.seen_path, "blob binary, kind string, version int")

    def findings(self) -> DataFrame:
        return self._table(self.found_path, f"blob binary, kind string, version int, spans {SPANS}")


def blob_of(column: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(column), 256))


def scan(docs: DataFrame, ledger: Ledger, rules: list[Rule] = RULES) -> int:
    """Scan the blobs that lack a row for a rule version; gives the number of pairs scanned."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    seen = ledger.seen().join(F.broadcast(wanted), ["kind", "version"]).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    keyed = docs.select("doc_id", blob_of().alias("blob"), text_or_empty().alias("text"))
    # one holder of each blob is read; the hash of its id and text length only breaks ties among rows without id
    first = keyed.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("holder"))
    due = first.join(seen, "blob", "left").withColumn("due", F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("done", F.array().cast("array<string>")))).where(F.size("due") > 0)
    holders = due.select("blob", F.col("holder.doc_id").alias("_id"), "due")
    same = (F.col("b.blob") == F.col("h.blob")) & F.col("b.doc_id").eqNullSafe(F.col("h._id"))
    texts = keyed.alias("b").join(holders.alias("h"), same).select("b.blob", "b.text", "h.due")

    def of_rule(rule: Rule) -> Column:
        spans = F.when(F.array_contains("due", rule.kind), rule_spans(F.col("text"), rule)).otherwise(F.array().cast(SPANS))
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), spans.alias("spans"))

    scanned = checkpointed(texts.select("blob", "due", F.filter(F.array(*[of_rule(r) for r in rules]), lambda x: F.size(x["spans"]) > 0).alias("found")), "scanned")
    found = scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.kind", "f.version", "f.spans").distinct()
    found.write.mode("append").parquet(ledger.found_path)
    # the ledger is written last: a run that is lost before scans its blobs again
    pairs = scanned.select("blob", F.explode("due").alias("kind")).distinct().join(F.broadcast(wanted), "kind").select("blob", "kind", "version")
    pairs.write.mode("append").parquet(ledger.seen_path)
    return scanned.agg(F.sum(F.size("due"))).first()[0] or 0


def secrets(docs: DataFrame, ledger_path: str | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """All columns of ``docs``, ``_base`` and ``_spans``: spans of each row, from the ledger after it was brought up to date.

    Without a path the ledger is a new one in the shared scratch folder.
    """
    return shielded(docs, lambda given: _spans_of(given, ledger_path, rules), ("_base", "_spans"))


def _spans_of(docs: DataFrame, ledger_path: str | None, rules: list[Rule]) -> DataFrame:
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or scratch_dir(spark, "ledger"))
    scan(docs, ledger, rules)
    wanted = spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, _rank int")
    found = ledger.findings().join(F.broadcast(wanted), ["kind", "version"])
    # a run that was repeated may have left a blob's findings twice
    spans = F.explode("spans").alias("s")
    by_blob = found.select("blob", "_rank", spans).select("blob", F.struct(F.col("s.start"), F.col("_rank"), F.col("s.end"), F.col("s.kind")).alias("s"))
    each = by_blob.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("_all")).withColumnRenamed("blob", "_found_blob")
    plain = F.transform(F.coalesce("_all", F.array().cast("array<struct<start:int,_rank:int,end:int,kind:string>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    joined = docs.withColumn("_blob", blob_of()).join(each, F.col("_blob") == F.col("_found_blob"), "left")
    out = joined.withColumn("_spans", plain).withColumn("_base", F.filter("_spans", lambda s: s["kind"].isin(*BASE)))
    return out.drop("_blob", "_found_blob", "_all")
