"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by four fifths.

Shingles are 64-bit hashes; their numeric order is the common order of the prefix filter. Two linked
sets share at least l shingles in their l-prefixes, the first n - ceil(0.8 n) + l shingles, for every l.

1. A task turns each text into its set size, two fingerprints and its longest prefix (l up to n/20 + 1).
   Equal sets form a class and go on as one document.
2. Prefix shingles are counted over all classes, one row of each. A class that shares fewer than l of its longest prefix with anyone has
   no link and ends here.
3. Every other class lengthens its prefix to the l that its estimated cost asks for: occurrences of its shingles
   to be met, plus a verification for each candidate, of which at most occurrences / l have l in common.
4. The whole sets of these candidates are made again from their texts. Candidates that share one of their rarest shingles,
   through stars around each shingle's smallest holder, fall into clusters. A cluster larger than a block is cut into blocks by set size and hash, bounded in classes and shingles, and two blocks meet in a task. There pairs that share
   the smaller l of the two are verified on the whole sets, and a spanning forest of the links leaves the task.
   So large groups cost arithmetic in numpy, but no row for a pair.
5. Components of those edges give the classes, and so every row, their component.

Defined results: null, empty and blank texts have no shingle, link with nothing (not even with each other) and are
their own component; fewer than five words are one shingle; rows of one id are one document: different texts under one id are in
one component, the one with most shingles is compared for it, and the others join what equals them; rows without id take part in no link, but get the component of an equal set that has an id, else
null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.common import WordHashes, arrow_rows, checkpointed, mix, shielded, window_hashes
from siftmark.llm.graph import components

WIDTH = 5
PERCENT = 80
# Cost of verifying one candidate against that of meeting one shared shingle.
VERIFY_COST = 40
BLOCK_DOCS = 400
BLOCK_SHINGLES = 400_000
FILTER_BITS = 22


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    return np.unique(window_hashes(hashes.of(text), WIDTH))


def longest_level(n):
    return n // 20 + 1


def one_prefix(n):
    """Length of the prefix in which linked sets share one shingle at least."""
    return n - (PERCENT * n + 99) // 100 + 1


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if len(arrays) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for ids, texts in arrow_rows(batches, ["doc_id", "text"]):
        sizes, ones, twos, prefixes = [], [], [], []
        for text in texts:
            found = shingles(text, hashes)
            n = len(found)
            sizes.append(n)
            ones.append(np.bitwise_xor.reduce(found) if n else np.uint64(0))
            twos.append(mix(found * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) if n else np.uint64(0))
            prefixes.append(found[: one_prefix(n) + longest_level(n) - 1] if n else found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(ones, np.uint64).view(np.int64)), pa.array(np.array(twos, np.uint64).view(np.int64)), _lists(prefixes)],
            ["doc_id", "n", "fp1", "fp2", "prefix"],
        )


def _utf8(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def adaptive_level(n: int, places: np.ndarray, counts: np.ndarray) -> int:
    """The l of least estimated cost; 0 if some l shows that there is no link.

    ``places`` are the prefix positions of shingles that others hold too, ``counts`` how many hold them.
    """
    order = np.argsort(places)
    met, first = np.cumsum((counts - 1)[order]), one_prefix(n)
    levels = np.arange(1, longest_level(n) + 1)
    shared = np.searchsorted(places[order], first + levels - 1)
    if (shared < levels).any():
        return 0
    listed = met[shared - 1]
    return int(levels[np.argmin(listed + VERIFY_COST * listed / levels)])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_doc, out_n, out_level = [], [], []
        flat = batch.column("shared").flatten()
        offsets = batch.column("shared").offsets.to_numpy()
        base = offsets[0]
        place, count = (flat.field(i).to_numpy() for i in range(2))
        for i, (doc, n) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("n").to_pylist())):
            a, b = offsets[i] - base, offsets[i + 1] - base
            level = adaptive_level(n, place[a:b], count[a:b])
            if level:
                out_doc.append(doc)
                out_n.append(n)
                out_level.append(level)
        yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_level, pa.int32())], ["doc", "n", "level"])


def _short(token: str):
    """48 bits of a shingle's hash, for counting: equal shingles stay equal, so the counts can only come out too high."""
    return F.shiftrightunsigned(token, 16).alias("token")


def candidates(classes: DataFrame) -> DataFrame:
    """Classes (doc, n, level) that share enough of their longest prefix to have a link."""
    tokens = classes.select("doc", F.posexplode("prefix").alias("place", "whole")).select("doc", "place", _short("whole"))
    counts = tokens.groupBy("token").count().where("count > 1")
    shared = tokens.join(counts, "token").groupBy("doc").agg(F.collect_list(F.struct("place", "count")).alias("shared"))
    enough = shared.join(classes.select("doc", "n"), "doc").where(F.size("shared") >= F.expr("n div 20 + 1")).select("doc", "n", "shared")
    return enough.mapInArrow(_choose, "doc long, n long, level int")


def clusters(whole: DataFrame) -> DataFrame:
    """(doc, cluster): classes that share one of their rarest shingles, directly or through others.

    ``whole`` holds the sets of the candidates. With the shingles of each in order of their counts, linked classes share one
    in their one-prefixes, which leave out the frequent fifths: passages that many documents hold join nobody.
    """
    tokens = whole.select("doc", F.explode("found").alias("whole")).select("doc", _short("whole"))
    counts = tokens.groupBy("token").count().where("count > 1")
    listed = tokens.join(counts, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("shared"))
    shared = listed.join(whole.select("doc", "n"), "doc")
    own = F.col("n") - F.size("shared")  # shingles nobody else holds come first
    rarest = shared.withColumn("left", (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - own).cast("int")).where("left > 0")
    held = checkpointed(rarest.select("doc", F.explode(F.slice("shared", F.lit(1), F.col("left"))).alias("t")).select("doc", "t.token"), "rarest")
    hubs = held.groupBy("token").agg(F.min("doc").alias("hub"), F.count("*").alias("held")).where("held > 1").select("token", "hub")
    edges = held.join(hubs, "token").select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    return components(edges).withColumnsRenamed({"node": "doc", "component": "cluster"})


def _blocks(near: DataFrame) -> DataFrame:
    """A row for every meeting of a class's block: (cluster, low, low_part, high, high_part, side, doc, level).

    A cluster within the bounds of one block meets once. A larger one is cut into bands, whose set sizes differ by less than the
    threshold allows, and these into parts by hash; linked classes lie in one band or in two that follow each other.
    """
    totals = near.groupBy("cluster").agg(((F.count("*") <= BLOCK_DOCS) & (F.sum("n") <= BLOCK_SHINGLES)).alias("one"))
    band = F.when(F.col("one"), 0).otherwise(1 + F.floor(F.log("n") / F.log(F.lit(100.0 / PERCENT)) + 1e-9)).cast("int")
    banded = checkpointed(near.select("doc", "n", "level", "cluster").join(totals, "cluster").withColumn("band", band), "banded")
    sizes = banded.groupBy("cluster", "band").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    below = sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_below"))
    above = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_above"))
    around = sizes.join(below, ["cluster", "band"], "left").join(above, ["cluster", "band"], "left")
    placed = banded.join(around, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))

    def upto(column: str):
        return F.when(F.coalesce(F.col(column), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(column) - 1)).otherwise(F.array().cast("array<int>"))

    def meeting(low, low_part, high, high_part, side):
        return F.struct(low.alias("low"), low_part.alias("low_part"), high.alias("high"), high_part.alias("high_part"), side.alias("side"))

    band, part = F.col("band"), F.col("part")
    own = F.transform(upto("parts"), lambda p: meeting(band, F.least(part, p), band, F.greatest(part, p), F.when(p == part, 2).when(part < p, 0).otherwise(1)))
    up = F.transform(upto("parts_above"), lambda p: meeting(band, part, band + 1, p, F.lit(0)))
    down = F.transform(upto("parts_below"), lambda p: meeting(band - 1, p, band, part, F.lit(1)))
    return placed.select("cluster", "doc", "n", "level", F.explode(F.concat(own, up, down)).alias("m")).select("cluster", "m.*", "doc", "n", "level")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], most: int = 4_000_000) -> np.ndarray:
    """Numbers of common values of every pair of arrays (distinct values each)."""
    n, m = len(left), len(right)
    out = np.zeros(n * m, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    own_a, own_b = np.repeat(np.arange(n), [len(x) for x in left]), np.repeat(np.arange(m), [len(x) for x in right])
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, own_a, own_b = a[order_a], b[order_b], own_a[order_a], own_b[order_b]
    start, stop = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    hit = stop > start
    own_a, start, size = own_a[hit], start[hit], (stop - start)[hit]
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        sizes = size[first:last]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = np.repeat(own_a[first:last], sizes) * m + own_b[np.repeat(start[first:last], sizes) + inner]
        out += np.bincount(keys, minlength=n * m)
        first = last
    return out.reshape(n, m)


def linked(left: list[np.ndarray], right: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    a, b = np.array([len(x) for x in left])[:, None], np.array([len(x) for x in right])[None, :]
    return 100 * counts >= PERCENT * (a + b - counts)


def _forest(rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given edges connect, without loops."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    kept = []
    for a, b in zip(rows.tolist(), columns.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a meeting, as a spanning forest."""
    docs, levels = group["doc"].to_numpy(), group["level"].to_numpy()
    found = [np.asarray(f, np.int64) for f in group["found"]]
    tokens = [f[: one_prefix(len(f)) + level - 1] for f, level in zip(found, levels)]  # in the order of unsigned hashes
    side = group["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    edges: list[tuple[int, int]] = []
    if len(left) and len(right):
        shared = _overlaps([tokens[i] for i in left], [tokens[j] for j in right])
        maybe = (shared >= np.minimum(levels[left][:, None], levels[right][None, :])) & (docs[left][:, None] != docs[right][None, :])
        keep_left, keep_right = left[maybe.any(axis=1)], right[maybe.any(axis=0)]
        maybe = maybe[maybe.any(axis=1)][:, maybe.any(axis=0)]
        if len(keep_left):
            a, b = [found[i] for i in keep_left], [found[j] for j in keep_right]
            i, j = np.nonzero(maybe & linked(a, b, _overlaps(a, b)))
            edges = _forest(docs[keep_left[i]], docs[keep_right[j]])
    return pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges]}, dtype="int64")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds the given ids; ids that are not in it are not among them."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(batch.column(0).to_numpy())).astype(np.int64))], ["bit"])

    # Bits are combined into words of 64 by an aggregate, map-side first: the driver gets at most 2^FILTER_BITS / 64 rows.
    words = ids.mapInArrow(bits, "bit long").groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = words.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little").astype(bool)


def _bit(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)


def _whole_sets(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The sets of the documents in ``near``. A fixed-size bit table spares the others the shuffle; the join is exact."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(near.select("doc")))

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            wanted = batch.filter(pa.array(sent.value[_bit(batch.column("doc_id").to_numpy(zero_copy_only=False))]))
            for ids, texts in arrow_rows([wanted], ["doc_id", "text"]):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists([shingles(t, hashes) for t in texts])], ["doc", "found"])

    return _utf8(docs).where("doc_id is not null").mapInArrow(recompute, "doc long, found array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, two fingerprints, longest prefix."""
    return checkpointed(_utf8(docs).mapInArrow(_sets, "doc_id long, n long, fp1 long, fp2 long, prefix array<long>"), "sets")


def class_prefixes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, n, prefix) of one row per class.

    A bit table of fixed size marks the rows that may be copies or share their id. Rows it does not mark stand for their
    class for certain and go on from their scan task; the others are few and are joined with the classes.
    """
    named = sets.where("n > 0 and doc_id is not null").withColumnRenamed("doc_id", "doc")
    copies = named.select(F.col("doc").alias("own"), "n", "fp1", "fp2").join(classes, ["n", "fp1", "fp2"]).where("own <> doc").select(F.col("own").alias("doc"))
    repeated = named.groupBy("doc").count().where("count > 1").select("doc")
    bits = sets.sparkSession.sparkContext.broadcast(_filter_of(copies.union(repeated)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("marked", pa.array(bits.value[_bit(batch.column("doc").to_numpy())]))

    made = named.select("doc", "n", "fp1", "prefix").mapInArrow(mark, "doc long, n long, fp1 long, prefix array<long>, marked boolean")
    first = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "fp1"))
    exact = made.where("marked").join(classes.select("doc", "n", "fp1"), ["doc", "n", "fp1"], "left_semi").withColumn("_n", first).where("_n = 1")
    return made.where("not marked").select("doc", "n", "prefix").union(exact.select("doc", "n", "prefix"))


def component_rows(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, fingerprints, component_id."""
    sets = sets_of(docs)
    print_ = ["n", "fp1", "fp2"]
    classes = checkpointed(sets.where("n > 0 and doc_id is not null").groupBy(*print_).agg(F.min("doc_id").alias("doc")), "classes")
    near = checkpointed(candidates(class_prefixes(sets, classes)), "candidates")
    whole = checkpointed(_whole_sets(docs, near).join(near.select("doc", "n"), "doc").where(F.size("found") == F.col("n")).dropDuplicates(["doc", "n"]), "near-sets")
    grouped = checkpointed(near.join(clusters(whole), "doc"), "clusters")
    met = _blocks(grouped).join(whole, ["doc", "n"])
    links = met.groupBy("cluster", "low", "low_part", "high", "high_part").applyInPandas(_meet, "a long, b long")
    rows = sets.select("doc_id", *print_).join(classes, print_, "left")
    # one id under several classes joins them
    several = rows.where("doc is not null and doc_id is not null").groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("top"), F.collect_set("doc").alias("_all")).where("a <> top")
    found = components(checkpointed(links.union(several.select("a", F.explode("_all"))), "edges"))
    placed = rows.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    own = F.coalesce("component", "doc", "doc_id")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "fp1", "fp2", own.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    return component_rows(docs).select("doc_id", "n_shingles", "component_id")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component: the row of its smallest id. Rows without id or shingle stay, as do extra columns of any name."""
    return shielded(docs, _first_of_each)


def _first_of_each(docs: DataFrame) -> DataFrame:
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "_id")
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_id"), "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text"))
    return named.withColumn("_n", number).where("_n = 1").drop("_n").unionByName(docs.where("doc_id is null"))
