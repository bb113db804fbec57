"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ``width`` consecutive words of an item; an item of fewer words is one window. Patterns of
one length share a table. The search looks at the block (word pair) that ends at a position: the shift table, addressed by
the block's hash, says how far the next possible end of a pattern lies, and blocks that end no pattern are skipped. Where
the shift is zero, the bucket of the window's last and first block gives the few patterns to compare byte by byte. Patterns
are offsets into the joined item texts, and all tables are flat arrays.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.words import fold, frame, merged, utf8, word_pieces
from spanwise.session import materialize

WIDTH = 10
#: Characters of item texts whose tables are broadcast together; more items are searched in further passes.
BLOCK_CHARS = 8_000_000
#: Shifts are bytes; a shorter shift than the possible one loses nothing.
MOST_SHIFT = 255

_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class Table:
    """Shift table and buckets of patterns that all have ``length`` words: items are added, then the table is sealed."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.blocks, self.left = array("I"), bytearray()
        self.keys, self.begins, self.ends, self.owners = array("Q"), array("q"), array("q"), array("q")
        self.digests = bytearray()

    def add(self, words: list[bytes], offset: int, owner: int) -> None:
        """All windows of an item whose joined words start at ``offset``; owner -1 has no name."""
        m, last = self.length, self.length - self.block
        hashes = [crc32(b, crc32(a)) for a, b in zip(words, words[1:])] if self.block == 2 else [crc32(w) for w in words]
        self.blocks.extend(hashes)
        # A block's distance from the end of the nearest window that holds it.
        self.left += bytes(min(MOST_SHIFT, max(0, last - k)) for k in range(len(hashes)))
        for k in range(len(words) - m + 1):
            window = b" ".join(words[k : k + m])
            self.keys.append(hashes[k + last] << 32 | hashes[k])
            self.begins.append(offset)
            self.ends.append(offset + len(window))
            self.owners.append(owner)
            self.digests += xxhash.xxh3_128_digest(window)
            offset += len(words[k]) + 1

    def sealed(self) -> Table:
        """Shifts by hash (blocks that share a place take the least), windows by bucket, equal windows once with all owners."""
        places = 1 << max(10, (4 * len(self.blocks)).bit_length())
        shift = np.full(places, min(MOST_SHIFT, self.length - self.block + 1), np.uint8)
        np.minimum.at(shift, np.frombuffer(self.blocks, np.uint32) & (places - 1), np.frombuffer(self.left, np.uint8))
        self.shift, self.mask = shift.tobytes(), places - 1
        keys, owners = np.frombuffer(self.keys, np.uint64), np.frombuffer(self.owners, np.int64)
        high, low = np.frombuffer(self.digests, np.uint64).reshape(-1, 2).T
        order = np.lexsort((owners, low, high, keys))
        keys, owners, high, low = keys[order], owners[order], high[order], low[order]
        differs = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        fresh = differs(keys) | differs(high) | differs(low)
        named = (owners >= 0) & (fresh | differs(owners))
        group = np.cumsum(fresh) - 1
        flat = lambda kind, x: array(kind, x.tobytes())
        self.begins = flat("q", np.frombuffer(self.begins, np.int64)[order][fresh])
        self.ends = flat("q", np.frombuffer(self.ends, np.int64)[order][fresh])
        self.keys, self.owners = flat("Q", keys[fresh]), flat("q", owners[named])
        self.owned = flat("q", np.searchsorted(group[named], np.arange(group[-1] + 2)))
        del self.blocks, self.left, self.digests
        return self

    def search(self, text: bytes, words: list[bytes], base: int, spans: list, owners: set) -> None:
        """Add the spans (word numbers) and the owners of all occurrences; ``text`` holds the windows."""
        m, two, n = self.length, self.block == 2, len(words)
        shift, mask, keys, end = self.shift, self.mask, self.keys, self.length - 1
        while end < n:
            last = crc32(words[end], crc32(words[end - 1])) if two else crc32(words[end])
            step = shift[last & mask]
            if step:
                end += step
                continue
            start = end - m + 1
            key = last << 32 | (crc32(words[start + 1], crc32(words[start])) if two else last)
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                window = b" ".join(words[start : end + 1])
                while at < len(keys) and keys[at] == key:
                    if text[self.begins[at] : self.ends[at]] == window:
                        if spans and spans[-1][0] <= base + start <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], base + end + 1)
                        else:
                            spans.append((base + start, base + end + 1))
                        owners.update(self.owners[self.owned[at] : self.owned[at + 1]])
                        break
                    at += 1
            end += 1


@dataclass
class Patterns:
    """Joined item texts, the items' names, and one table for each pattern length."""

    text: bytes
    names: list[str]
    tables: list[Table]


def patterns(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> Patterns:
    """All windows of the items; an item without a name has windows nobody owns."""
    text, numbers, made = bytearray(), {}, {}
    for item, content in items:
        words = fold(utf8(content)).split()
        if not words:
            continue
        owner = -1 if item is None else numbers.setdefault(item, len(numbers))
        size = min(width, len(words))
        made.setdefault(size, Table(size)).add(words, len(text), owner)
        text += b" ".join(words) + b" "
    return Patterns(bytes(text), list(numbers), [made[k].sealed() for k in sorted(made)])


def _searcher(shared, overlap: int):
    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series, old_spans: pd.Series, old_items: pd.Series) -> pd.DataFrame:
        known, rows = shared.value, []
        for text, known_spans, known_items in zip(texts, old_spans, old_items):
            spans: list[tuple[int, int]] = []
            owners: set[int] = set()
            n_words = 0
            for base, words in word_pieces(fold(utf8(text)), overlap):
                n_words = base + len(words)
                for table in known.tables:
                    own: list[tuple[int, int]] = []
                    table.search(known.text, words, base, own, owners)
                    spans += own
            items = {known.names[k] for k in owners}
            if known_spans is not None:
                spans += zip(map(int, known_spans[::2]), map(int, known_spans[1::2]))
                items |= set(known_items)
            rows.append((n_words, [x for span in merged(spans) for x in span], sorted(items)))
        return frame(rows, _FOUND.names)

    return search


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (start, end word numbers in turn, disjoint) and ``hit_items``.

    Columns of these names are replaced. Words are lower-cased runs of ASCII digits and letters and of non-ASCII characters.
    A null or empty text has no words and no hits. A null item text has no windows; an item without an id still marks
    words but is not listed; repeated items count once. An empty benchmark hits nothing. Items are searched in blocks of
    about ``block_chars`` characters, so what is broadcast is bounded; each block is one more pass over the documents.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words")).where("words IS NOT NULL")
    total = known.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    out = docs.withColumn("__found", F.lit(None).cast(_FOUND))
    for k in range(blocks):
        made = patterns([(r.item, r.words) for r in known.where(block == k).collect()], width)
        search = _searcher(spark.sparkContext.broadcast(made), width - 1)
        if k:
            out = materialize(out, "decontaminate")
        out = out.withColumn("__found", search(F.col("text"), F.col("__found.spans"), F.col("__found.items")))
    return out.withColumns({
        "n_words": F.col("__found.n_words"), "hit_spans": F.col("__found.spans"), "hit_items": F.col("__found.items"),
    }).drop("__found")


def hit_words(spans: str = "hit_spans"):
    """Number of words inside the spans."""
    return F.aggregate(
        F.transform(spans, lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hold no window of an item, with their own columns."""
    found = find_benchmark(docs.withColumn("__row", F.struct("*")), benchmark, width)
    return found.where(F.size("hit_spans") == 0).select("__row.*")
