"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their bit counts (0, 1 or 2),
written in unary so that the Manhattan distance of two vectors is the bit count of their XOR. That distance never exceeds
the Hamming distance, so vectors further than ``bits`` apart need no check. For the grid, the 32 coordinates form six
blocks: fingerprints at most three bits apart differ in at most three coordinates and agree on all coordinates of at
least three blocks. Each of the 20 choices of three blocks is a grid; a cell holds the vectors that agree there.

Inside a cell not all pairs are compared. Members within ``bits`` of the cell's hub (its most frequent fingerprint) are
linked to the hub alone; only members further away are compared with the others. Links lost that way join two members
that the hub already connects, so components stay exact.

A cell of more than ``HOT`` members is cut again before anything in it is compared: the coordinates its grid left open fall
into four classes, at most three of them can differ, so a link shows in the finer cell of a class that agrees. Finer cells
have hubs of their own, and are cut once more by other classes where they are still large. The cuts keep every link.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.words import utf8, word_pieces
from spanwise.session import materialize

BITS = 3
SHINGLE = 3
SEED = 42
_LOW = 0x5555555555555555
#: Segments of each of the six blocks.
_BLOCKS = (5, 5, 5, 5, 6, 6)
#: Cells with more members are cut again.
HOT = 256


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint; zero for a text without words."""
    total, ones, short = 0, np.zeros(64, dtype=np.int64), []
    for _, part in word_pieces(utf8(text).lower(), words - 1):
        if len(part) >= words:
            runs = map(b" ".join, zip(*(part[k:] for k in range(words))))
        else:
            short = part
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64)
        total += len(h)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    if short and not total:
        # Pieces overlap, so the last one holds all words of a text that has fewer than a shingle.
        total, whole = 1, np.array([xxhash.xxh64_intdigest(b" ".join(short), SEED)], dtype=np.uint64)
        ones += np.unpackbits(whole.view(np.uint8))
    return int(np.packbits(ones * 2 > total).view(np.int64)[0]) if total else 0


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(x) for x in texts], dtype="int64")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments in unary: 00, 01 or 11."""
    low = _long(_LOW)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _grids() -> list[int]:
    masks, at = [], 0
    for size in _BLOCKS:
        masks.append(((1 << 2 * size) - 1) << 2 * at)
        at += size
    return [a | b | c for a, b, c in combinations(masks, 3)]


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _cuts() -> list[list[int]]:
    """Four classes of coordinates for each further cut: by segment number, then across those."""
    by_number = [sum(3 << 2 * s for s in range(k, 32, 4)) for k in range(4)]
    across = [sum(3 << 2 * s for s in range(32) if (s + s // 4) % 4 == k) for k in range(4)]
    return [by_number, across]


def _in_cells(rows: DataFrame, masks: Column) -> DataFrame:
    """Rows (``fp``, ``n``, ``seg``) once for each mask of coordinates, with the coordinates themselves as ``cell``."""
    return rows.select("fp", "n", "seg", F.explode(masks).alias("mask")).withColumn("cell", F.col("seg").bitwiseAND(F.col("mask")))


def _compared(far: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """Links of members far from their hub with any member of their cell."""
    far = far.select("mask", "cell", F.col("fp").alias("a"), F.col("seg").alias("seg_a"))
    others = members.select("mask", "cell", F.col("fp").alias("b"), F.col("seg").alias("seg_b"))
    return far.join(others, ["mask", "cell"]).where(
        (F.col("a") != F.col("b")) & (_apart("seg_a", "seg_b") <= bits) & (_apart("a", "b") <= bits)
    ).select("a", "b")


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (``fp``, ``n`` copies) that connect what lies within ``bits``.

    ``hot`` only chooses where cells are cut again; the components are the same for any value.
    """
    if bits > 3:
        raise ValueError("the grids are whole for up to three differing bits")
    rows = fps.select("fp", "n", embedding(F.col("fp")).alias("seg"))
    cells, found, cuts = _in_cells(rows, F.array(*(_long(m) for m in _grids()))), [], _cuts()
    while True:
        hubs = cells.groupBy("mask", "cell").agg(
            F.max_by("fp", F.struct("n", "fp")).alias("hub"), F.count("*").alias("size")
        ).where("size > 1")
        members = materialize(cells.join(hubs, ["mask", "cell"]), "simhash-cells")
        far = members.where(_apart("fp", "hub") > bits)
        found.append(members.where((F.col("fp") != F.col("hub")) & (_apart("fp", "hub") <= bits)).select(
            F.col("fp").alias("a"), F.col("hub").alias("b")
        ))
        small = F.col("size") <= hot if cuts else F.lit(True)
        found.append(_compared(far.where(small), members.where(small), bits))
        large_far = far.where(~small).select("mask", "cell").distinct() if cuts else None
        if large_far is None or large_far.isEmpty():
            break
        large = members.where(~small).join(large_far, ["mask", "cell"], "left_semi")
        cells = _in_cells(large, F.array(*(F.col("mask").bitwiseOR(_long(m)) for m in cuts.pop(0))))
    return reduce(DataFrame.unionByName, found).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node`` and the smallest node ``root`` of its component, for all nodes of the edges ``a`` > ``b``.

    Alternating star contraction: each node's larger neighbours are hung below its smallest neighbour, then its smaller
    ones. A component becomes a star in about log(size) rounds, whatever its shape. Each round is written to the shared
    folder, so lost executors cost one round and the lineage stays short.
    """
    edges = materialize(edges, "links")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))
        )).alias("e")).select("e.*").where("a > b").distinct()
        edges = materialize(small, "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The documents with their fingerprint ``fp``, and for each fingerprint its ``component_id`` and ``keeper``.

    Copies meet at their fingerprint: they are counted there before anything is shuffled, and only distinct fingerprints
    enter the grids. Null and empty texts have fingerprint zero and are linked like any other. ``component_id`` is the
    smallest non-null doc_id of the component, null if it has none. ``keeper`` is the (id, text hash) of the one row
    that stays: the smallest id (null ids last), of repeated ids the smallest hash.
    """
    rank = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("hash"))
    seen = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), rank.alias("rank"), fingerprints("text").alias("fp")), "fingerprints")
    per_fp = materialize(seen.groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.min("rank").alias("rank"), F.count("*").alias("n")
    ), "distinct-fingerprints")
    roots = materialize(components(links(per_fp.select("fp", "n"), bits)), "components")
    rooted = per_fp.join(roots, per_fp.fp == roots.node, "left").select(
        "fp", "doc_id", "rank", F.coalesce("root", "fp").alias("root")
    )
    group = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("rank").alias("keeper"))
    groups = materialize(rooted.select("fp", "root").join(group, "root").drop("root"), "fingerprint-groups")
    return seen, groups


def membership(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row a document: ``doc_id``, ``fp``, ``component_id``."""
    seen, groups = near_duplicates(docs, bits)
    return seen.drop("rank").join(groups.drop("keeper"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents with their own columns, one of each component; fully repeated rows count as one."""
    _, groups = near_duplicates(docs, bits)
    keepers = groups.select(F.col("keeper.id").alias("__id"), F.col("keeper.hash").alias("__hash")).distinct()
    ranked = docs.withColumns({
        "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__hash": F.xxhash64("text"),
    })
    return ranked.join(keepers, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(docs.columns)
