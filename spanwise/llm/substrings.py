"""Substring dedup: paragraphs, lines, sentences and clauses are normalised and hashed, digests grouped globally, the earliest stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.session import materialize

#: Whole lines, and paragraphs between blank lines, each tiling the text. They hold short sentences, lists and shouted text,
#: none of whose sentences has words enough by itself.
LINES = (
    re.compile(r"[^\n]*\n+|[^\n]+\Z"),
    re.compile(r".+?(?:\n[ \t\r]*\n\s*|\Z)", re.S),
)
#: Finer units: sentences cut at line ends, sentences across lines, clauses. A passage pasted into running text is cut off in
#: the middle of a sentence at both ends, and lines may be broken anew; these reach what lines cannot.
PIECES = (
    re.compile(r"[^\n.!?。！？．｡]*[\n.!?。！？．｡]+|[^\n.!?。！？．｡]+\Z"),
    re.compile(r"[^.!?。！？．｡]*[.!?。！？．｡]+|[^.!?。！？．｡]+\Z"),
    re.compile(r"[^\n.!?。！？．｡,;:，、；：､]*[\n.!?。！？．｡,;:，、；：､]+|[^\n.!?。！？．｡,;:，、；：､]+\Z"),
)
GRAINS = LINES + PIECES
#: Texts without any cut.
WHOLES = (re.compile(r".+", re.S),)
#: Units of fewer words are common speech, not copied passages.
MIN_WORDS = 6
#: Scripts without spaces have no such words; so many of their letters make a unit too.
MIN_LETTERS = 20
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_LAST = (1 << 63) - 1
_COLUMNS = ["doc", "start", "end", "high", "low"]


def _units(min_words: int, grains: tuple[re.Pattern, ...]):
    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                # A unit that two grains share counts once: by where its words start, and its digest.
                known = set()
                for grain in grains:
                    for m in grain.finditer(text):
                        words = m[0].lower().split()
                        if len(words) < min_words and (m[0].isascii() or len(UNSPACED.findall(m[0])) < MIN_LETTERS):
                            continue
                        d = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                        key = (m.end() - len(m[0].lstrip()), d)
                        if key not in known:
                            known.add(key)
                            rows.append((doc, m.start(), m.end(), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
                if len(rows) > 200_000:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return units


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, grains: tuple[re.Pattern, ...] = GRAINS) -> DataFrame:
    """Units to remove: ``doc_id``, ``start``, ``end`` (code points of the original), ``kept_doc_id``, ``kept_start``.

    A unit is a line, a paragraph, a sentence, within a line or across lines, or a clause (see ``GRAINS``); with ``WHOLES``
    among the grains also a text. Reported spans may hold one another; a unit is compared lower-cased, white space aside. Of
    equal units the one of the smallest doc_id stays, within a document the first; documents without an id come last. Null and empty texts, and
    texts of fewer than six words and fewer than 20 letters of a script without spaces, have no units. Rows that repeat an id count as one document: equal units at equal
    offsets in them are one occurrence. Digests have 128 bits. Grouping counts before it shuffles, and the join back is on
    digests that occur more than once, so one very common unit is spread by adaptive skew handling.
    """
    named = docs.where("text IS NOT NULL AND text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")
    units = materialize(named.mapInPandas(_units(min_words, grains), "doc long, start int, end int, high long, low long"), "units")
    first = units.groupBy("high", "low").agg(
        F.min(F.struct("doc", "start")).alias("kept"), F.count("*").alias("n")
    ).where("n > 1").select("high", "low", F.col("kept.doc").alias("kept_doc"), F.col("kept.start").alias("kept_start"))
    later = units.join(first, ["high", "low"]).where("doc <> kept_doc OR start <> kept_start")
    own = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return later.select(own("doc").alias("doc_id"), "start", "end", own("kept_doc").alias("kept_doc_id"), "kept_start")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``cleaned`` and ``removed`` (the spans cut out, original offsets). Columns of these names are replaced.

    Units of all grains are cut out, lines, paragraphs and whole texts too.
    """
    cut = repeated_units(docs, min_words, GRAINS + WHOLES).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cut")
    )

    @F.pandas_udf("string")
    def remaining(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            if text is None or cuts is None:
                out.append(text)
                continue
            at, parts = 0, []
            for s in cuts:
                parts.append(text[at : max(at, s["start"])])
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    joined = docs.drop("removed", "cleaned").withColumnRenamed("doc_id", "__doc_id").join(
        cut.withColumnRenamed("doc_id", "__cut_id"), F.col("__doc_id") == F.col("__cut_id"), "left"
    ).drop("__cut_id").withColumnRenamed("__doc_id", "doc_id")
    return joined.withColumn("cleaned", remaining(F.col("text"), F.col("__cut"))).withColumnRenamed("__cut", "removed")
