"""Merkle dataset manifest: every row a leaf, a tree for each language, one root, and a proof for each row.

1. A leaf is the SHA-256 of the row's fields, each with its length. Leaves are numbered by id within their language, in ranges.
2. ``BLOCK`` consecutive leaves are an aligned block, built by streaming append: open subtrees of falling height wait for their
   siblings, and each later completion extends the partial witnesses of all leaves below both sides. Block roots are numbered as
   their blocks are, so they are appended further in the same way, block by block, until one node is left; the roots of the
   languages are appended likewise. No task holds more than ``BLOCK`` nodes.
3. The witnesses go down again: each block gets the witness of its root once, finishes those of its own nodes, and folds each
   row's leaf along them. Witnesses are never shuffled with the rows.

Defined results: a null field is told apart from an empty one; null languages and null ids come first; rows of one id follow each
other by digest, so repeated rows are leaves of their own; extra columns are no part of a leaf; a lone leaf is its own root, and a
node without a sibling is hashed alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import checkpointed, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 4096
# Steps of a witness: a sibling on the left, one on the right, or none.
LEFT, RIGHT, ALONE = "<", ">", "-"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row; ``changed`` replaces fields."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Appender:
    """Append-only tree: open subtrees of falling height, and the witness that each leaf has so far."""

    def __init__(self, size: int, height: int):
        self.height = height
        self.steps = np.full((height, size), ALONE, object)
        self.open: list[tuple[int, int, int, str]] = []  # height, first leaf, leaf after the last, digest
        self.size = 0

    def append(self, digest: str) -> None:
        self.open.append((0, self.size, self.size + 1, digest))
        self.size += 1
        self._join_equals()

    def _join_equals(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            level, middle, end, right = self.open.pop()
            _, start, _, left = self.open.pop()
            self.steps[level, start:middle] = RIGHT + right
            self.steps[level, middle:end] = LEFT + left
            self.open.append((level + 1, start, end, sha(left, right)))

    def root(self) -> str:
        """The digest at the full height; subtrees that stay alone are hashed alone."""
        while self.open[-1][0] < self.height:
            level, start, end, digest = self.open.pop()
            self.open.append((level + 1, start, end, sha(digest)))
            self._join_equals()
        return self.open[-1][3]

    def witness(self, leaf: int) -> list[str]:
        return self.steps[:, leaf].tolist()


def fold(digest: str, witness: Iterable[str]) -> str:
    """The root that a digest and its witness lead to."""
    for step in witness:
        side, other = step[0], step[1:]
        digest = sha(other, digest) if side == LEFT else sha(digest, other)  # alone: the other is empty
    return digest


def appended(block: pd.DataFrame, size: int) -> Appender:
    """A block's tree; it is as high as a full block where its tree has other blocks."""
    block.sort_values("place", inplace=True, ignore_index=True)
    tree = Appender(len(block), (min(int(block["nodes"].iloc[0]), size) - 1).bit_length())
    for digest in block["digest"]:
        tree.append(digest)
    return tree


def _block_root(key: tuple, block: pd.DataFrame, size: int) -> pd.DataFrame:
    above = -(-int(block["nodes"].iloc[0]) // size)
    return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "digest": [appended(block, size).root()], "nodes": [above]})


def _block_of(size: int) -> Column:
    return F.floor(F.col("place") / size).cast("long").alias("block")


def grown(nodes: DataFrame, size: int) -> list[DataFrame]:
    """Levels of block roots above ``nodes`` (tree, place, digest, nodes of the tree on this level), the first being ``nodes`` and the last one node for each tree."""
    levels = [nodes]
    most = nodes.agg(F.max("place")).first()[0] or 0
    while most > 0:
        roots = levels[-1].groupBy("tree", _block_of(size)).applyInPandas(lambda key, block: _block_root(key, block, size), "tree string, place long, digest string, nodes long")
        levels.append(checkpointed(roots, "manifest-roots"))
        most //= size
    return levels


def _with_witness(block: pd.DataFrame, above: pd.DataFrame, size: int) -> pd.DataFrame:
    if not len(block):
        return pd.DataFrame({"tree": [], "place": [], "witness": []})
    tree = appended(block, size)
    tree.root()
    upper = list(above["witness"].iloc[0])
    return pd.DataFrame({"tree": block["tree"], "place": block["place"], "witness": [tree.witness(i) + upper for i in range(len(block))]})


def witnessed(levels: list[DataFrame], tops: DataFrame, size: int) -> DataFrame:
    """(tree, place, witness) of the nodes of ``levels[0]``; ``tops`` holds the witness of each tree's last node."""
    above = tops
    for nodes in reversed(levels[:-1]):
        pair = nodes.groupBy("tree", _block_of(size)).cogroup(above.groupBy("tree", F.col("place").alias("block")))
        above = pair.applyInPandas(lambda block, above: _with_witness(block, above, size), "tree string, place long, witness array<string>")
    return above


def _proved(block: pd.DataFrame, above: pd.DataFrame, size: int) -> pd.DataFrame:
    columns = ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "witness"]
    if not len(block):
        return pd.DataFrame({c: [] for c in columns})
    tree = appended(block, size)
    tree.root()
    upper, subroot = list(above["witness"].iloc[0]), above["subroot"].iloc[0]
    rows = []
    for i, (doc_id, leaf, held) in enumerate(zip(block["doc_id"], block["digest"], block["held"])):
        path = tree.witness(i) + upper
        rows.append((doc_id, leaf, subroot, sha(*[s[1:] for s in path]), fold(leaf if held is None else held, path), path))
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def leaves(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """(doc_id, tree, digest, held): the leaf of each row, and the digest that ``held`` says is found in its place, else null."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    found = F.lit(None).cast("string") if held is None else held
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest().alias("digest"), found.alias("held"))


def manifest(docs: DataFrame, held: Column | None = None, size: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, witness) of each row.

    ``held`` gives, over the columns of ``docs``, the leaf now found where it may differ from the recorded one (else null).
    A witness lists a step for each level: ``<`` and a left sibling, ``>`` and a right one, or ``-``.
    """
    rows = checkpointed(leaves(docs, held), "manifest-leaves")
    numbers = numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest")], group="tree", name="place", total="nodes")
    placed = checkpointed(numbers, "manifest-placed")
    languages = grown(placed.select("tree", "place", "digest", "nodes"), size)
    subroots = languages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
    ordered = checkpointed(numbered(subroots, [F.col("language")], name="place", total="nodes"), "manifest-subroots")
    whole = grown(ordered.select("tree", "place", "digest", "nodes"), size)
    top = whole[-1].select("digest").first()
    root = top[0] if top else None
    nothing = F.array().cast("array<string>").alias("witness")
    in_whole = witnessed(whole, whole[-1].select("tree", "place", nothing), size)
    tops = ordered.join(in_whole.drop("tree"), "place").select(F.col("language").alias("tree"), F.lit(0).cast("long").alias("place"), "witness")
    above = witnessed(languages[1:], tops, size) if len(languages) > 1 else tops  # of the blocks of leaves
    above = above.join(ordered.select(F.col("language").alias("tree"), F.col("digest").alias("subroot")), "tree")
    pair = placed.groupBy("tree", _block_of(size)).cogroup(above.groupBy("tree", F.col("place").alias("block")))
    proved = pair.applyInPandas(lambda block, above: _proved(block, above, size), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, witness array<string>")
    return proved.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"), "witness")

