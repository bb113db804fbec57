"""Byte-level BPE: backtracking encoder and offset-table decoder.

The encoder walks a pre-token from left to right with the longest vocabulary entry at each position (one Aho-Corasick pass
over the reversed bytes finds them all). Two neighbours stand only if the merges would not cross their border; otherwise
the encoder falls back to the next shorter entry, and to the token before it when none is left. A position found
impossible is never tried again, so the work stays linear. Decoding gathers bytes from one buffer by offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The byte-level pre-token pattern of the vocabulary, and the same for ASCII text.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
PRE_TOKEN_ASCII = re.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
)

#: Pre-tokens and pairs a worker remembers, and the longest pre-token that it remembers.
KEPT, KEPT_CHARS, KEPT_PAIRS = 150_000, 48, 400_000
#: Bytes of a pre-token from which on its matches and entries are kept in flat arrays, not listed.
LONG = 4096


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Entries by id, merges in order, and the added tokens that are cut out of a text first."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, letters = spec["model"], _byte_letters()
        self.digest = hashlib.sha256(data).hexdigest()
        as_bytes = lambda word: bytes(letters[c] for c in word)
        ids = {as_bytes(word): k for word, k in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.ids = ids
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read())


class Encoder:
    """Exact merges of a pre-token. Entries are numbered by age: the bytes, then the merges in order."""

    def __init__(self, vocabulary: Vocabulary):
        entries = [bytes([b]) for b in range(256)]
        age = {e: k for k, e in enumerate(entries)}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in vocabulary.merges:
            if a + b in age:
                raise ValueError("two merges make one entry; their order is then ambiguous")
            self.pairs[age[a], age[b]] = age[a + b] = len(entries)
            self.parts.append((age[a], age[b]))
            entries.append(a + b)
        self.age, self.length = age, [len(e) for e in entries]
        self.id = [vocabulary.ids[e] for e in entries]
        self.shorter = [next((age[e[:n]] for n in range(len(e) - 1, 0, -1) if e[:n] in age), -1) for e in entries]
        self.compatible: dict[int, bool] = {}
        self.search = ahocorasick.Automaton()
        for k, e in enumerate(entries):
            self.search.add_word(e[::-1].decode("latin-1"), k)
        self.search.make_automaton()
        self.added = vocabulary.added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known = _Known(self)

    def stand(self, left: int, right: int) -> bool:
        """Whether the two entries stay apart when merges are made in order; looked up in a table filled as pairs occur."""
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= KEPT_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._stand(left, right)
        return known

    def _stand(self, left: int, right: int) -> bool:
        # Undo the merges of both sides, youngest first: if ever the two parts at the border have a merge that is older
        # than the one undone last, that merge would have come first and crossed the border.
        undone = len(self.parts)
        while True:
            if self.pairs.get((left, right), undone) < undone:
                return False
            if left > right:
                undone, left = left, self.parts[left][1]
                if left == undone:
                    return True
            else:
                # Of equally old merges the left one is made first.
                undone, right = right + 1, self.parts[right][0]
                if right + 1 == undone:
                    if self.parts[left][1] == left:
                        return True
                    undone, left = left, self.parts[left][1]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.age.get(data)
        if whole is not None:
            return [self.id[whole]]
        n = len(data)
        longest = self._longest(data[::-1].decode("latin-1"))
        length, shorter, stand = self.length, self.shorter, self.stand
        dead = bytearray(n + 1)
        out = [] if n < LONG else array("i")
        at, before, entry = 0, -1, longest[n - 1]
        while at < n:
            while entry >= 0:
                end = at + length[entry]
                if not dead[end] and (before < 0 or stand(before, entry)):
                    break
                entry = shorter[entry]
            if entry >= 0:
                out.append(entry)
                at, before = end, entry
                entry = longest[n - 1 - at] if at < n else -1
            else:
                dead[at] = 1
                entry = out.pop()
                at -= length[entry]
                before = out[-1] if out else -1
        return [self.id[e] for e in out]

    def _longest(self, backwards: str):
        """The longest entry that starts at each place, by its last place in the reversed bytes."""
        # Of the entries that end at one place the longest is found first.
        found = self.search.iter(backwards)
        if len(backwards) < LONG:
            return dict(list(found)[::-1])
        longest = array("i", [-1]) * len(backwards)
        for end, entry in found:
            if longest[end] < 0:
                longest[end] = entry
        return longest

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        known = self.known.__getitem__
        runs = []
        for k, part in enumerate(self.cut.split(text) if self.cut else (text,)):
            if k % 2:
                runs.append(np.array([self.added[part]], dtype=np.int32))
            elif part:
                runs.append(np.fromiter(chain.from_iterable(map(known, pre_tokens(part))), dtype=np.int32))
        return runs[0] if len(runs) == 1 else np.concatenate(runs) if runs else np.empty(0, dtype=np.int32)


class _Known(dict):
    """Ids of short pre-tokens seen lately: the newest, and the generation before it, each within a fixed number."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoder.piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def pre_tokens(text: str) -> list[str]:
    return (PRE_TOKEN_ASCII if text.isascii() else PRE_TOKEN).findall(text)


class Decoder:
    """All entries' bytes in one buffer, with the offset of each id."""

    def __init__(self, vocabulary: Vocabulary):
        entries = {k: e for e, k in vocabulary.ids.items()} | {k: t.encode() for t, k in vocabulary.added.items()}
        parts = [entries.get(k, b"") for k in range(max(entries) + 2)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.unknown = len(parts) - 1

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = np.asarray(ids[at : at + (1 << 20)], dtype=np.int64)
            part = np.where((part < 0) | (part > self.unknown), self.unknown, part)
            first, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            out.append(self.buffer[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_IDS = T.ArrayType(T.IntegerType())
_MADE: dict = {}


def made(kind, shared):
    """The worker's encoder or decoder of a broadcast vocabulary, built once."""
    digest, vocabulary = shared
    key = (kind, digest)
    if key not in _MADE:
        _MADE[key] = kind(vocabulary.value)
    return _MADE[key]


def share(spark: SparkSession, path: str):
    """The vocabulary file, read once and broadcast (a file of a few MB)."""
    vocabulary = Vocabulary.read(path)
    return vocabulary.digest, spark.sparkContext.broadcast(vocabulary)


def int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """A column of integer lists from one array a row."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def encode(text: Column, shared) -> Column:
    """Token ids of the texts; none for a null or empty text."""

    @F.arrow_udf(_IDS)
    def ids(texts: pa.Array) -> pa.Array:
        encoder = made(Encoder, shared)
        return int_lists([encoder.encode(x.as_py() or "") for x in texts])

    return ids(text)


def decode(ids: Column, shared) -> Column:
    """Texts of token ids; unknown ids add nothing, bytes that are no UTF-8 become U+FFFD, null ids give an empty text."""

    @F.arrow_udf(T.StringType())
    def texts(column: pa.Array) -> pa.Array:
        decoder = made(Decoder, shared)
        return pa.array((decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column), pa.string())

    return texts(ids)


def round_trip(text: Column, shared) -> Column:
    """Token ids of the texts, and the texts decoded from them, in one pass through Python."""

    @F.arrow_udf(T.StructType([T.StructField("ids", _IDS), T.StructField("decoded", T.StringType())]))
    def both(texts: pa.Array) -> pa.Array:
        encoder, decoder = made(Encoder, shared), made(Decoder, shared)
        rows = [encoder.encode(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([int_lists(rows), pa.array(map(decoder.decode, rows), pa.string())], ["ids", "decoded"])

    return both(text)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``; columns of these names are replaced. Rows, repeated ones too, stay as they are.

    A null or empty text has no ids and an empty decoded text.
    """
    shared = share(docs.sparkSession, path)
    return docs.withColumn("__both", round_trip(F.col("text"), shared)).withColumns({
        "ids": F.col("__both.ids"), "decoded": F.col("__both.decoded")
    }).drop("__both")
