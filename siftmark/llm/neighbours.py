"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node, whose smallest ids are kept as the answer needs no more. Nodes are dealt to shards of about
``shard_size`` by hash; a task builds a shard's graph and stores it as flat arrays: vectors, ids, and for each layer the neighbour
lists in rows of fixed width. Queries travel in blocks to every shard, whose graph is sent once, ahead of them; the best of all shards are
merged by distance. The driver gets counts only, and plans whose size does not depend on the number of shards.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part;
rows without id take no part; of rows that share an id every distinct vector is a candidate of that id, and the nearest counts;
fewer candidates than asked for are all returned; ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.common import checkpointed

SHARD_SIZE = 2_000
WIDTH = 12  # links per node and layer; twice as many on the lowest
BUILD_BEAM = 60
SEARCH_BEAM = 80
QUERY_BLOCK = 256


class Graph:
    """Layers of neighbour lists over vectors. Row i of a layer's array lists the neighbours of node i, then -1."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.layers, self.entry = layers or [], entry

    def _far(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - query
        return np.einsum("ij,ij->i", gap, gap)

    def _beam(self, query: np.ndarray, starts: list[tuple[float, int]], layer: np.ndarray, width: int) -> list[tuple[float, int]]:
        """The nearest ``width`` nodes that a best-first walk from the starts meets, nearest first."""
        seen = np.zeros(len(layer), bool)
        seen[[n for _, n in starts]] = True
        ahead = list(starts)
        heapq.heapify(ahead)
        kept = [(-d, n) for d, n in starts]
        heapq.heapify(kept)
        while ahead:
            far, node = heapq.heappop(ahead)
            if len(kept) >= width and far > -kept[0][0]:
                break
            near = layer[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            limit = -kept[0][0] if len(kept) >= width else np.inf
            for d, n in zip(self._far(query, near).tolist(), near.tolist()):
                if d < limit or len(kept) < width:
                    heapq.heappush(ahead, (d, n))
                    heapq.heappush(kept, (-d, n))
                    if len(kept) > width:
                        heapq.heappop(kept)
                    limit = -kept[0][0]
        return sorted((-d, n) for d, n in kept)

    def _varied(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes in different directions: one is left out if it is closer to a chosen one than to the centre."""
        chosen: list[int] = []
        rest: list[int] = []
        for d, n in found:
            if len(chosen) >= most:
                break
            if chosen and (self._far(self.vectors[n], np.array(chosen)) < d).any():
                rest.append(n)
            else:
                chosen.append(n)
        return chosen + rest[: most - len(chosen)]

    def _link(self, layer: np.ndarray, node: int, other: int) -> None:
        row = layer[other]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = node
            return
        near = np.append(row, node)
        far = self._far(self.vectors[other], near)
        order = np.argsort(far, kind="stable")
        row[:] = -1
        kept = self._varied([(float(far[i]), int(near[i])) for i in order], len(row))
        row[: len(kept)] = kept

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        graph = cls(vectors)
        n = len(vectors)
        heights = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(WIDTH)).astype(int), 12) if n else np.zeros(0, int)
        graph.layers = [np.full((n, WIDTH * (2 if i == 0 else 1)), -1, np.int32) for i in range(int(heights.max(initial=0)) + 1)]
        top = -1
        for node in range(n):
            height = int(heights[node])
            if top >= 0:
                query = graph.vectors[node]
                found = [(float(graph._far(query, np.array([graph.entry]))[0]), graph.entry)]
                for level in range(top, -1, -1):
                    layer = graph.layers[level]
                    found = graph._beam(query, found, layer, BUILD_BEAM if level <= height else 1)
                    if level <= height:
                        for other in graph._varied(found, WIDTH):
                            graph._link(layer, other, node)
                            graph._link(layer, node, other)
            if height > top:
                top, graph.entry = height, node
        return graph

    def search(self, query: np.ndarray, width: int = SEARCH_BEAM) -> list[int]:
        if not len(self.vectors):
            return []
        query = query.astype(np.float32)
        found = [(float(self._far(query, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.layers) - 1, -1, -1):
            found = self._beam(query, found, self.layers[level], width if level == 0 else 1)
        return [n for _, n in found]


INDEX = "shard int, size int, dim int, entry int, vectors binary, ids array<array<long>>, layers array<binary>"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first")
    vectors = np.array(group["vector"].tolist(), np.float64)
    graph = Graph.build(vectors)
    row = {"shard": group["shard"].iloc[0], "size": len(vectors), "dim": vectors.shape[1], "entry": graph.entry, "vectors": vectors.tobytes(), "ids": [list(map(int, i)) for i in group["ids"]], "layers": [layer.tobytes() for layer in graph.layers]}
    return pd.DataFrame([row])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(lengths), F.size("vector") == F.col("n")).drop("n")


def index(rows: DataFrame, keep: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per shard: the graph as flat arrays. ``keep`` smallest ids stand for equal vectors."""
    rank = Window.partitionBy("vector").orderBy("id")
    first = rows.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= keep)
    nodes = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("first", F.element_at("ids", 1))
    nodes = checkpointed(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_size))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("first", "vector"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(_build, INDEX)


def _graph_of(row: dict) -> tuple[Graph, np.ndarray]:
    exact = np.frombuffer(row["vectors"], np.float64).reshape(row["size"], row["dim"])
    layers = [np.frombuffer(b, np.int32).reshape(row["size"], -1) for b in row["layers"]]
    return Graph(exact, layers, row["entry"]), exact


def _search(k: int, beam: int):
    """Answers from rows in order of their shard: its graph, then blocks of queries. A shard without a graph has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph, exact, ids = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["queries"] is None:
                    held, (graph, exact), ids = row["shard"], _graph_of(row), row["ids"]
                    continue
                if row["shard"] != held:
                    continue
                out = []
                for q in row["queries"]:
                    if len(q["vector"]) != exact.shape[1]:
                        continue
                    query = np.array(q["vector"], np.float64)
                    best = []
                    nodes = graph.search(query, max(beam, k + 1))
                    far = np.sqrt(((exact[nodes] - query) ** 2).sum(axis=1))
                    for node, d in zip(nodes, far.tolist()):
                        best += [(d, i) for i in ids[node] if i != q["id"]]
                    out += [(q["id"], q["n"], i, d) for d, i in heapq.nsmallest(k, best)]
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", "query_row", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", beam: int = SEARCH_BEAM, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, which is no neighbour of itself.

    A query that has several rows with different vectors is answered by the smallest distance over them.
    """
    shards = checkpointed(index(usable(vectors, id_column, vector_column), k + 1, shard_size), "shards")
    asked = usable(queries, id_column, vector_column).distinct()
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK))))
    blocks = asked.withColumn("n", F.xxhash64("vector")).groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "n", "vector")).alias("queries"))
    # the stated queries, in blocks, against every shard
    last = shards.agg(F.max("shard").alias("last"))
    asked_shards = blocks.crossJoin(F.broadcast(last)).select("queries", F.explode(F.sequence(F.lit(0), "last")).alias("shard"))
    both = shards.unionByName(asked_shards, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("queries").isNotNull())
    met = both.mapInArrow(_search(k, beam), "query_id long, query_row long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
