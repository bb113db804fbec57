"""Toxicity: a logistic classifier over word presence, regularised by counterfactuals.

Each labelled row that names a group is rewritten with the other groups of the same kind; the fit penalises the squared
change of the score (before the logistic curve, where scores near 0 and 1 still move) between the row and each rewriting,
so a neutral mention of a group carries no weight of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.words import fold, utf8, word_pieces
from spanwise.session import materialize

# Identity terms, by kind; terms of one kind are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
)

#: Labelled rows the classifier is fitted on at most, the first by hash. Their whole texts are used.
FIT_ROWS = 20_000
#: Words that carry a weight at most, besides the identity terms; with ``FIT_ROWS`` they bound what the driver holds.
FEATURES = 1_000
HASH_BITS = 20
RIDGE = 0.1
COUNTERFACTUAL = 5.0
#: Rows that hold a word, and its deviation from chance, from which on it can be a feature.
MIN_ROWS, MIN_DEVIATION = 5, 3


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << HASH_BITS) - 1)


_SWAPS = {bucket(a.encode()): [bucket(b.encode()) for b in kind if b != a] for kind in IDENTITY_TERMS for a in kind}


def distinct_words(text: str | None) -> set[bytes]:
    found: set[bytes] = set()
    for _, words in word_pieces(fold(utf8(text)), 0):
        found.update(words)
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pd.Series) -> pd.Series:
    known: dict[bytes, int] = {}
    rows = []
    for text in texts:
        ids = []
        for word in distinct_words(text):
            at = known.get(word)
            if at is None:
                if len(known) > 500_000:
                    known.clear()
                at = known[word] = bucket(word)
            ids.append(at)
        rows.append(np.unique(np.array(ids, dtype=np.int32)))
    return pd.Series(rows, dtype=object)


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Word buckets (``words``) and labels of at most ``rows`` labelled documents, the first by hash of the id.

    Of several texts of a document the first by hash teaches, once.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("words")))
    return texts.withColumn("words", _features("text")).groupBy("doc_id", "toxic").agg(first.alias("first")).select("toxic", "first.words")


def features(sampled: DataFrame, n: int, positive: int) -> list[int]:
    """Buckets of the words that tell the labels apart most, by how far their share in toxic rows is from chance, and of
    the identity terms that occur. Counted over whole texts by Spark; only what is chosen comes to the driver."""
    share = positive / n
    counts = sampled.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("seen"), F.sum("toxic").alias("inside")
    ).where((F.col("seen") >= MIN_ROWS) | F.col("word").isin(list(_SWAPS)))
    seen = F.col("seen")
    z = F.abs(F.col("inside") - seen * share) / F.sqrt(F.greatest(seen * share * (1 - share), F.lit(1e-9)))
    counts = counts.withColumn("z", F.when(seen >= MIN_ROWS, z).otherwise(0.0))
    top = counts.where(F.col("z") > MIN_DEVIATION).orderBy(F.desc("z"), "word").limit(FEATURES).select("word")
    named = counts.where(F.col("word").isin(list(_SWAPS))).select("word")
    return sorted({r.word for r in top.union(named).collect()})


def rewritings(words: set[int]) -> Iterator[set[int]]:
    """The row with one of its identity terms written as another of the kind, for each term and other."""
    for word in words:
        for other in _SWAPS.get(word, ()):
            yield words - {word} | {other}


def swap_penalty(rows: list[set[int]], column: dict[int, int]) -> np.ndarray:
    """The matrix P for which w' P w is the sum of squared changes of the score w over all rewritings of all rows."""
    penalty = np.zeros((len(column) + 1, len(column) + 1))
    for words in rows:
        for new in rewritings(words):
            change = [(column[x], 1.0) for x in new - words if x in column] + [(column[x], -1.0) for x in words - new if x in column]
            for i, a in change:
                for j, b in change:
                    penalty[i, j] += a * b
    return penalty


def fit(sampled: DataFrame) -> tuple[dict[int, float], float]:
    """Weights by word bucket, and the bias."""
    n, positive = sampled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive in (0, n):
        return {}, float(np.log((positive + 0.5) / (n - positive + 0.5)))
    chosen = features(sampled, n, positive)
    column = {b: k for k, b in enumerate(chosen)}
    k = len(chosen)
    # At most FIT_ROWS rows of at most the chosen words each; sorted, so that the fit does not depend on their order.
    held = sampled.select("toxic", F.array_sort(F.filter("words", lambda w: w.isin(chosen))).alias("words")) if k else sampled.select(
        "toxic", F.array().cast("array<int>").alias("words")
    )
    held = held.orderBy("toxic", "words").toArrow().combine_chunks()
    y = held["toxic"].to_numpy().astype(float)
    lists = held["words"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), sizes)
    x = np.zeros((n, k + 1), dtype=np.float32)
    x[owner, np.searchsorted(chosen, flat)] = 1
    x[:, k] = 1
    terms = np.isin(flat, list(_SWAPS))
    groups: dict[int, set[int]] = {}
    for row, word in zip(owner[terms].tolist(), flat[terms].tolist()):
        groups.setdefault(row, set()).add(word)
    # Words that are no identity terms are in both a row and its rewritings and take no part in the change.
    penalty = np.diag(np.append(np.full(k, RIDGE), 1e-6)) + COUNTERFACTUAL * swap_penalty(list(groups.values()), column)
    share = positive / n
    w = np.zeros(k + 1)
    w[k] = np.log(share / (1 - share))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(float)))
        slope = x.T @ (p - y).astype(np.float32) + penalty @ w
        weight = np.sqrt(np.maximum(p * (1 - p), 1e-6)).astype(np.float32)
        curve = penalty.copy()
        for at in range(0, n, 2048):
            part = x[at : at + 2048] * weight[at : at + 2048, None]
            curve += part.T @ part
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return {int(b): float(v) for b, v in zip(chosen, w)}, float(w[k])


def scored(docs: DataFrame, training: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier). A column of that name is replaced.

    Learns from the whole texts of at most ``rows`` labelled rows; all rows are scored, over their whole texts. Null and empty texts get the
    score of a text without known words. Unlabelled rows and null labels teach nothing; of several labels of a document
    the highest counts; without labels of both kinds every score is the share of toxic ones.
    """
    sampled = materialize(sample(training, labels, rows), "toxicity-sample")
    shared = docs.sparkSession.sparkContext.broadcast(fit(sampled))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        known: dict[bytes, float] = {}
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            words = distinct_words(text)
            fresh = [x for x in words if x not in known] if known else list(words)
            if len(known) + len(fresh) > 500_000:
                known.clear()
                fresh = words
            for word in fresh:
                known[word] = weights.get(bucket(word), 0.0)
            # Sorted, so that the sum does not depend on the order of the set.
            out[k] = bias + sum(sorted(x for x in map(known.__getitem__, words) if x))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn("score", score(F.col("text")))
