"""Merkle manifest of a dataset: persistent trees with path copying.

Every row is a leaf, every group of rows (a source) a tree, and the trees' roots are the leaves of one more tree. Nodes of
one level lie in aligned blocks of 16^3: a task grows the three levels of a block at a time, and the blocks' tops are the
nodes of the next tier, which is dealt out anew. A changed leaf makes a version of its block that copies the three
ancestors of that leaf and shares all other nodes with the version before; above the block the version goes on along the
block's path to the root, row by row. Only digests are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.operators.ordered import numbered_by_range
from spanwise.session import materialize

#: Children of a node, levels of a block, and leaves of a block.
FAN, DEPTH = 16, 3
BLOCK = FAN**DEPTH

_NODE = "tree string, at long, digest string"
_PATH = "left array<string>, right array<string>, root string"
_PROOF = (
    "key long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "verified boolean, copies array<string>"
)


def sized(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(sized, values)), 256)


class Node(NamedTuple):
    digest: str
    children: tuple


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def parent(children: tuple) -> Node:
    return Node(_hash("".join([c.digest for c in children])), children)


def grown(digests: list[str], levels: int) -> Node:
    """The top of a block."""
    nodes = [Node(d, ()) for d in digests]
    for _ in range(levels):
        nodes = [parent(tuple(nodes[k : k + FAN])) for k in range(0, len(nodes), FAN)]
    return nodes[0]


def replaced(top: Node, at: int, levels: int, digest: str, copies: list[str]) -> Node:
    """The version of a block with another leaf: its ancestors are copied (and listed, from below), the rest is shared."""
    if levels:
        span = FAN ** (levels - 1)
        k = at // span
        new = replaced(top.children[k], at % span, levels - 1, digest, copies)
        made = parent(top.children[:k] + (new,) + top.children[k + 1 :])
    else:
        made = Node(digest, ())
    copies.append(made.digest)
    return made


def beside(top: Node, at: int, levels: int) -> list[tuple[str, str]]:
    """Digests left and right of the path to a leaf, joined, from the leaf's level up."""
    found = []
    for level in reversed(range(levels)):
        k, at = divmod(at, FAN**level)
        digests = [c.digest for c in top.children]
        found.append(("".join(digests[:k]), "".join(digests[k + 1 :])))
        top = top.children[k]
    return found[::-1]


def height(block: int, size: int) -> int:
    """Levels of a block. Only the first block of a tree can be its only one, and lower than the others."""
    if block or size == BLOCK:
        return DEPTH
    levels = 0
    while FAN**levels < size:
        levels += 1
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one block after another; rows begin with tree and block, and come sorted by them."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][:2] != row[:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_TEXTS = pa.list_(pa.string())
_NODES = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.string())])
_PATHS = pa.schema([*_NODES, ("left", _TEXTS), ("right", _TEXTS), ("root", pa.string())])
_PROOFS = pa.schema([
    ("key", pa.int64()), ("tree", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
    ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("copies", _TEXTS),
])


def _dealt(nodes: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Nodes by block, in order, each block behind its header."""
    rows = nodes.withColumn("block", F.floor(F.col("at") / BLOCK))
    if headers is not None:
        marked = headers.withColumnRenamed("at", "block").withColumn("at", F.lit(-1).cast("long"))
        rows = rows.unionByName(marked, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("tree", "block", "at")]
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").select("tree", "block", "at", *rest)


def _tops(batches):
    tops = ((rows[0][0], rows[0][1], grown([r[3] for r in rows], height(rows[0][1], len(rows))).digest) for rows in _blocks(batches))
    yield from _packed(tops, _NODES)


def _lifted(batches):
    def lifted():
        for (tree, block, _, _, left, right, root), *rows in _blocks(batches):
            levels = height(block, len(rows))
            top = grown([r[3] for r in rows], levels)
            for k, row in enumerate(rows):
                near = beside(top, k, levels)
                yield tree, row[2], row[3], [a for a, _ in near] + left, [b for _, b in near] + right, root

    yield from _packed(lifted(), _PATHS)


def paths(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, at, digest) with the digests left and right of their path on every level below the root, and the root."""
    if nodes.where("at > 0").isEmpty():
        none = F.array().cast("array<string>")
        return nodes.select("tree", "at", "digest", none.alias("left"), none.alias("right"), F.col("digest").alias("root"))
    above = paths(block_tops(nodes))
    dealt = _dealt(nodes.select("tree", "at", "digest"), above.drop("digest"))
    return materialize(dealt.mapInArrow(_lifted, f"{_NODE}, {_PATH}"), "merkle-paths")


def block_tops(nodes: DataFrame) -> DataFrame:
    """The nodes of the next tier: one a block."""
    return materialize(_dealt(nodes.select("tree", "at", "digest")).mapInArrow(_tops, _NODE), "merkle-tops")


def _proved(batches):
    def proved():
        for header, *rows in _blocks(batches):
            tree, block = header[:2]
            left, right, subroot, root = header[6:]
            levels = height(block, len(rows))
            top = grown([r[3] for r in rows], levels)
            for k, (_, _, _, leaf, key, changed, *_) in enumerate(rows):
                copies: list[str] = []
                folded = replaced(top, k, levels, leaf if changed is None else changed, copies).digest
                for a, b in zip(left, right):
                    folded = _hash(a + folded + b)
                    copies.append(folded)
                near = beside(top, k, levels)
                proof = _hash("".join([a + b for a, b in near] + [a + b for a, b in zip(left, right)]))
                yield key, tree, leaf, subroot, root, proof, folded, folded == root, None if changed is None else copies

    yield from _packed(proved(), _PROOFS)


def manifest(docs: DataFrame, key: str, tree: str, leaf: Column, changed: Column) -> DataFrame:
    """One row per row of ``docs``: its proof, and what the tree becomes with its changed leaf.

    ``leaf`` and ``changed`` are digests as lowercase hex; a null ``changed`` keeps the leaf. Leaves of a tree ascend by
    the long ``key``, trees by ``tree``, nulls first in both; rows of one key ascend by their digest, so repeated rows are
    leaves of their own and any order of theirs gives the same result. Result: ``key``, ``tree``, ``leaf``, ``subroot``
    (the tree's root), ``root``, ``proof_sha256`` (of the siblings from the leaf up), ``folded_root``, ``verified`` and
    ``copies``, the nodes that the version of a changed leaf has for itself, from the leaf to its root. A tree of one leaf
    has that leaf as its root. No rows give no rows; columns of other names are not read.
    """
    leaves = materialize(docs.select(
        F.col(key).cast("long").alias("key"), F.col(tree).cast("string").alias("tree"), leaf.alias("digest"), changed.alias("changed")
    ), "merkle-leaves")
    order = [F.coalesce("key", F.lit(-(2**63))), F.col("key").isNotNull(), F.col("digest")]
    placed = numbered_by_range(leaves, ["tree"], order, "at").select("tree", (F.col("at") - 1).alias("at"), "digest", "key", "changed")
    placed = materialize(placed, "merkle-placed")
    blocks = block_tops(placed)
    below = paths(blocks)
    subroots = below.where("at = 0").select("tree", F.col("root").alias("digest"))
    ranked = numbered_by_range(subroots, [], [F.col("tree").isNotNull(), F.coalesce("tree", F.lit(""))], "at")
    ranked = materialize(ranked.select(F.lit("").alias("tree"), F.col("tree").alias("source"), (F.col("at") - 1).alias("at"), "digest"), "merkle-trees")
    upper = paths(ranked.select("tree", "at", "digest")).alias("u").join(ranked.alias("r"), F.col("u.at") == F.col("r.at"))
    upper = upper.select("r.source", "u.left", "u.right", "u.root")
    headers = below.alias("b").join(upper.alias("u"), F.col("b.tree").eqNullSafe(F.col("u.source"))).select(
        "b.tree", "b.at", F.concat("b.left", "u.left").alias("left"), F.concat("b.right", "u.right").alias("right"),
        F.col("b.root").alias("subroot"), "u.root")
    return _dealt(placed, headers).mapInArrow(_proved, _PROOF)
