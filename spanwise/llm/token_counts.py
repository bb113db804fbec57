"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves hold characters and tokens of a run of pre-tokens, inner
nodes their sums. An edit re-encodes from the last pre-token that cannot have looked at the edited characters up to the
first old pre-token border behind them, and updates the sums above the touched leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.bpe import KEPT_CHARS, PRE_TOKEN, PRE_TOKEN_ASCII, Encoder, int_lists, made, pre_tokens, share

#: A pre-token's extent depends on this many characters behind it at most (a contraction's letters).
LOOK_AHEAD = 2
#: Pre-tokens in each generation of remembered counts.
KEPT_COUNTS = 400_000

LEAVES = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
COUNTED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_encoded", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("leaves", LEAVES),
])


class Tree:
    """Sums of characters and tokens over leaves, in heap order."""

    def __init__(self, chars, tokens):
        n = max(1, len(chars))
        self.first = 1 << (n - 1).bit_length()
        self.chars, self.tokens = self._grown(chars), self._grown(tokens)

    def _grown(self, leaves) -> list[int]:
        sums = np.zeros(2 * self.first, dtype=np.int64)
        sums[self.first : self.first + len(leaves)] = leaves
        top = self.first
        while top > 1:
            sums[top // 2 : top] = sums[top : 2 * top].reshape(-1, 2).sum(axis=1)
            top //= 2
        # Edits touch single nodes, for which plain lists are quicker.
        return sums.tolist()

    def leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at a position inside the text, and where that leaf starts."""
        node, start, chars = 1, 0, self.chars
        while node < self.first:
            node *= 2
            if position - start >= chars[node]:
                start += chars[node]
                node += 1
        return node, start

    def put(self, node: int, last: int, chars: int, tokens: int) -> None:
        """Let one leaf stand for the leaves up to ``last``, and update the sums above them, level by level."""
        for sums, total in ((self.chars, chars), (self.tokens, tokens)):
            sums[node:last] = [0] * (last - node)
            sums[node] = total
            low, high = node // 2, (last - 1) // 2
            while low:
                for k in range(low, high + 1):
                    sums[k] = sums[2 * k] + sums[2 * k + 1]
                low, high = low // 2, high // 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        chars, tokens = (np.array(sums[self.first :], dtype=np.int32) for sums in (self.chars, self.tokens))
        return chars[chars > 0], tokens[chars > 0]


class Counts(dict):
    """Numbers of tokens of short pre-tokens seen lately: the newest, and the generation before it, each within a fixed number."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = len(self.encoder.piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_COUNTS:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


def counts_of(encoder: Encoder) -> Counts:
    """The encoder's table of counts."""
    if not hasattr(encoder, "counts"):
        encoder.counts = Counts(encoder)
    return encoder.counts


def edit(tree: Tree, encoder: Encoder, text: str, start: int, end: int, new: str) -> tuple[str, int]:
    """Replace text[start:end]; the edited text and the number of pre-tokens encoded for it."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    edited = text[:start] + new + text[end:]
    if not text:
        node, at = tree.first, 0
    else:
        node, at = tree.leaf(min(max(start - LOOK_AHEAD, 0), len(text) - 1))
    counts, pattern = counts_of(encoder), PRE_TOKEN_ASCII if edited.isascii() else PRE_TOKEN
    moved, begin, tokens, encoded = len(new) - (end - start), at, 0, 0
    last = len(tree.chars)  # behind the touched leaves
    while at < len(edited):
        old = at - moved
        if at >= start + len(new) and old >= end and old < len(text):
            other, border = tree.leaf(old)
            if border == old:
                last = other
                break
        match = pattern.match(edited, at)
        tokens += counts[match[0]]
        encoded += 1
        at = match.end()
    # Text put in right before an untouched first leaf joins that leaf.
    kept = (tree.chars[node], tree.tokens[node]) if last == node else (0, 0)
    tree.put(node, max(last, node + 1), at - begin + kept[0], tokens + kept[1])
    return edited, encoded


def _leaves(text: str, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    pieces, counts = pre_tokens(text), counts_of(encoder)
    chars = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces))
    return chars, np.fromiter(map(counts.__getitem__, pieces), dtype=np.int32, count=len(pieces))


def _leaf_column(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([int_lists([r[k] for r in rows]) for k in range(2)], LEAVES.names)


def _edited_column(encoder: Encoder, texts, leaves, edits, trees: bool) -> pa.StructArray:
    tokens, encoded, new_texts, new_leaves = [], [], [], []
    for text, own, change in zip(texts, leaves, edits):
        tree, again = Tree(*own), 0
        for e in sorted(change.as_py() or (), key=lambda e: (e["start"], e["end"]), reverse=True):
            text, more = edit(tree, encoder, text, e["start"], e["end"], e["text"] or "")
            again += more
        tokens.append(tree.tokens[1])
        encoded.append(again)
        new_texts.append(text)
        if trees:
            new_leaves.append(tree.leaves())
    columns = [pa.array(tokens, pa.int64()), pa.array(encoded, pa.int64()), pa.array(new_texts, pa.string())]
    return pa.StructArray.from_arrays([*columns, _leaf_column(new_leaves)] if trees else columns, COUNTED.names[: 3 + trees])


def count(text: Column, edits: Column, shared, trees: bool) -> Column:
    """Numbers of tokens and pre-tokens, leaves of the text's tree, and what :func:`recount` gives for it, in one pass through Python."""
    edited = COUNTED if trees else T.StructType(COUNTED.fields[:3])
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("n_pieces", T.LongType())]

    @F.arrow_udf(T.StructType([*own, T.StructField("edited", edited), *([T.StructField("leaves", LEAVES)] if trees else [])]))
    def counted(texts: pa.Array, changes: pa.Array) -> pa.Array:
        encoder = made(Encoder, shared)
        leaves = [_leaves(x.as_py() or "", encoder) for x in texts]
        numbers = [pa.array([int(n.sum()) for _, n in leaves], pa.int64()), pa.array([len(c) for c, _ in leaves], pa.int64())]
        edited = _edited_column(encoder, (x.as_py() or "" for x in texts), leaves, changes, trees)
        columns = [*numbers, edited, *([_leaf_column(leaves)] if trees else [])]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "n_pieces", "edited", "leaves"][: len(columns)])

    return counted(text, edits)


def recount(text: Column, leaves: Column, edits: Column, shared) -> Column:
    """Apply edits to stored trees: arrays of start, end, text in code points of the original, disjoint, last one first."""

    @F.arrow_udf(COUNTED)
    def counted(texts: pa.Array, trees: pa.Array, changes: pa.Array) -> pa.Array:
        own = ((x["chars"].values.to_numpy(), x["tokens"].values.to_numpy()) for x in trees)
        return _edited_column(made(Encoder, shared), (x.as_py() or "" for x in texts), own, changes, True)

    return counted(text, leaves, edits)


def edited_counts(docs: DataFrame, edits: Column, path: str, trees: bool = True) -> DataFrame:
    """``docs`` with ``leaves`` (its tree's leaves), ``n_tokens``, ``n_pieces``, and ``edited`` (tokens, pre-tokens encoded again, text, leaves).

    Columns of these names are replaced. Without ``trees`` both ``leaves`` stay in the tasks, and are not given out. Text of
    added tokens is counted as ordinary text. A null text is an empty one; edits beyond its end are cut to it; null edits
    change nothing; repeated rows are counted each by itself.
    """
    shared = share(docs.sparkSession, path)
    both = docs.withColumn("__both", count(F.col("text"), edits, shared, trees))
    names = ["n_tokens", "n_pieces", "edited", *(["leaves"] if trees else [])]
    return both.withColumns({c: F.col(f"__both.{c}") for c in names}).drop("__both")
