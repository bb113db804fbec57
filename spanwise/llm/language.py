"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters per language over all training rows: each task adds up dense counts
and hands out its non-zero ones, which are summed by (language, bucket). Scoring broadcasts the matrix of log
probabilities (languages x 2^15 buckets) and sums its columns per document in numpy, a stretch of texts at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
GRAMS = 3
SMOOTHING = 0.5
#: The matrix grows with the languages; more than this many are refused, which bounds the broadcast to 64 MB.
MOST_LANGUAGES = 512
#: Characters whose n-grams are scored together; longer texts are cut into such stretches.
STRETCH = 1 << 19

_LETTERS: list[np.ndarray] = []
_PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool))
    return _LETTERS[0]


def stretches(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and characters of the texts, a bounded stretch at a time.

    Letters are lower-cased; all else becomes a gap (0). Gaps run together, and each text starts and ends with one.
    """
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        for at in range(0, len(text), STRETCH):
            data = text[at : at + STRETCH].lower().encode("utf-32-le", "surrogatepass")
            chars = np.frombuffer(data, dtype=np.uint32)
            chars = np.concatenate([[0], np.where(_letters()[chars], chars, 0), [0]]).astype(np.uint32)
            chars = chars[(chars != 0) | (np.append(1, chars[:-1]) != 0)]
            if len(chars) < 2:
                continue
            rows.append((row, len(chars)))
            parts.append(chars)
            size += len(chars)
            if size >= STRETCH:
                yield np.repeat([r for r, _ in rows], [n for _, n in rows]), np.concatenate(parts)
                rows, parts, size = [], [], 0
    if parts:
        yield np.repeat([r for r, _ in rows], [n for _, n in rows]), np.concatenate(parts)


def grams(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and buckets of the n-grams of each length that hold a letter and no two gaps in a row."""
    hashed = np.zeros(len(chars), dtype=np.uint32)
    good = np.ones(len(chars), dtype=bool)
    for n in range(GRAMS):
        m = len(chars) - n
        if m <= 0:
            return
        tail = chars[n:]
        hashed = hashed[:m] * np.uint32(0x01000193) + tail * np.uint32(0x9E3779B1) + np.uint32(n + 1)
        good = good[:m] & ((tail != 0) | (chars[n - 1 : -1] != 0)) if n else good
        at = np.flatnonzero(good & (chars != 0) if n == 0 else good)
        mixed = hashed[at] ^ (hashed[at] >> np.uint32(15))
        yield at, ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, part in batch.groupby("lang", sort=False):
            own = counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
            own[BUCKETS] += len(part)
            for _, chars in stretches(part["text"]):
                for _, buckets in grams(chars):
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": own[used]})


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the (buckets + 1) x languages log probabilities; the last row holds the priors.

    Learns from all rows of ``text`` and ``lang``; rows without either teach nothing.
    """
    known = docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    summed = known.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")
    ).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(by_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + 1, len(by_lang)))
    for k, row in enumerate(by_lang):
        counts[row.buckets, k] = row.counts
    logs = np.empty_like(counts)
    logs[:-1] = np.log(counts[:-1] + SMOOTHING) - np.log(counts[:-1].sum(axis=0) + SMOOTHING * BUCKETS)
    logs[-1] = np.log(counts[-1] / counts[-1].sum()) if by_lang else 0
    return [row.lang for row in by_lang], logs.astype(np.float32)


def score(texts, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scores of each text, and its number of n-grams (none: it has no letter)."""
    sums, seen = np.tile(logs[-1].astype(float), (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
    for rows, chars in stretches(texts):
        for at, buckets in grams(chars):
            if not len(at):
                continue
            owner = rows[at]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums[owner[first]] += np.add.reduceat(logs[buckets], first, axis=0, dtype=float)
            seen[owner[first]] += np.diff(np.append(first, len(owner)))
    return sums, seen


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language. Columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing could be learned.
    Ties go to the language that comes first in string order. Repeated rows are scored alike; very long texts are scored
    in stretches, whole.
    """
    langs, logs = fit(training)
    shared = docs.sparkSession.sparkContext.broadcast((langs, logs))

    @F.pandas_udf(_PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, logs = shared.value
        if not langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        sums, seen = score(list(texts), logs)
        best = sums.argmax(axis=1)
        posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({
            "lang_pred": [langs[k] if n else "und" for k, n in zip(best, seen)],
            "score": np.where(seen > 0, np.clip(posterior, 0, 1), 0.0),
        })

    return docs.withColumn("__p", predict(F.col("text"))).withColumns({
        "lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")
    }).drop("__p")
