"""Merkle manifest, sharding and whitening against plain versions, and their edge cases."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from plain import ascii_lower  # noqa: E402

from spanwise.llm import merkle, sharding, whitening  # noqa: E402
from spanwise.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, shard string, row string, bucket long, digest string"
LONG = "Some words that go on and on, again. " * 40_000


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def sized(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, text):
    return sha("".join(map(sized, (row.doc_id, row.source, row.lang, row.n_chars, text))))


def plain_tree(digests):
    """The root, and for every leaf its (left, right) siblings from below."""
    beside = [[] for _ in digests]
    spans = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        for k, span in enumerate(spans):
            first = k // 16 * 16
            for leaf in span:
                beside[leaf].append(("".join(digests[first:k]), "".join(digests[k + 1 : first + 16])))
        digests = [sha("".join(digests[k : k + 16])) for k in range(0, len(digests), 16)]
        spans = [sum(spans[k : k + 16], []) for k in range(0, len(spans), 16)]
    return digests[0], beside


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r.source].append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: plain_tree([leaf for _, _, leaf, _ in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, above = plain_tree([grown[s][0] for s in names])
    found = []
    for s, up in zip(names, above):
        for (_, _, leaf, r), down in zip(sorted(trees[s], key=lambda x: x[:3]), grown[s][1]):
            folded = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                folded = plain_leaf(r, ascii_lower(r.text))
            for a, b in down + up:
                folded = sha(a + folded + b)
            found.append((r.doc_id, leaf, grown[s][0], root, sha("".join(a + b for a, b in down + up)), folded, folded == root))
    return found


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    more = ("x", 7, "y", "z", 9, "d")
    rows = [
        (None,) * 11, (1, "", "en", "a", 0, *more), (2, None, "en", "a", None, *more), (3, "One", "en", None, 3, *more), (3, "One", "en", None, 3, *more),
        (4, "!!! ...", None, "b", 7, *more), (5, LONG, "en", "a", len(LONG), *more), (6, LONG, "fr", "é", 5, *more), (None, "One", "en", "c", 27, *more),
        (7, "Ünïcödé \U0001f600 \x00 and\ttabs", "de", "", 10, *more), (7, "Another", "de", "c", 10, *more), *[(None,) * 11] * 40,
        *[(k, f"Text {k}", "en", "\U0001f600" if k % 3 else "ﬀ", k, *more) for k in range(100, 160)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def over(monkeypatch, frame):
    monkeypatch.setattr("spanwise.llm.queries.table", lambda spark, sf_dir, name: frame)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_matches_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = QUERIES["op11_merkle_manifest"](spark, SF).collect()
    assert ordered(found) == ordered(plain_manifest(rows))
    assert 0 < sum(not r.verified for r in found) < len(found) / 2


def test_manifest_of_odd_rows(spark, odd, none, monkeypatch):
    over(monkeypatch, odd)
    assert ordered(QUERIES["op11_merkle_manifest"](spark, SF).collect()) == ordered(plain_manifest(odd.collect()))
    over(monkeypatch, none)
    assert QUERIES["op11_merkle_manifest"](spark, SF).collect() == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"hot": 2 * merkle.BLOCK + 1, "full": merkle.BLOCK}, {f"s{k}": 1 for k in range(300)}])
def test_manifest_over_tiers(spark, sizes, monkeypatch):
    rows = [(k * 1000 + i, f"Text {i}", "en", s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    over(monkeypatch, df)
    assert ordered(QUERIES["op11_merkle_manifest"](spark, SF).collect()) == ordered(plain_manifest(df.collect()))


def test_versions_share_untouched_nodes():
    top = merkle.grown([sha(str(k)) for k in range(600)], 3)
    copies = []
    new = merkle.replaced(top, 300, 3, sha("new"), copies)
    assert len(copies) == 4 and copies[-1] == new.digest
    assert new == merkle.grown([sha("new") if k == 300 else sha(str(k)) for k in range(600)], 3)
    same = [sum(a is b for a, b in zip(x.children, y.children)) for x, y in ((top, new), (top.children[1], new.children[1]))]
    assert same == [2, 15]


def test_versions_end_at_their_root(spark):
    df = spark.createDataFrame([(k, "a") for k in range(5000)], "doc_id long, source string")
    leaf = merkle.leaf_digest(F.col("doc_id"))
    found = merkle.manifest(df, "doc_id", "source", leaf, F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("x"), 256)))
    for r in found.collect():
        assert (r.copies is None) == (r.key % 7 > 0)
        if r.copies:
            assert len(r.copies) == 5 and r.copies[0] == sha("x") and r.copies[-1] == r.folded_root != r.root


def held(docs, found, shards):
    rows = found.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {(r.shard, r.slot): (r.doc_id, r.text) for r in rows}


def test_shards_hold_all_rows_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op12_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts.items()}
    one = held(docs, sharding.sharded(docs, 40, bucket_bytes=50_000), 40)
    assert one == held(docs, sharding.sharded(docs.repartition(7), 40, bucket_bytes=50_000), 40)
    assert one != held(docs, sharding.sharded(docs, 40, bucket_bytes=50_000, seed=1), 40)


def test_shuffle_matches_plain(spark):
    """Buckets one after another, each in the order of its generator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    size = sum(len(r.text.encode()) + 16 for r in docs.collect())
    buckets = -(-size // 50_000)
    rows = docs.select("doc_id", F.xxhash64(F.lit(12), F.col("doc_id").cast("string"), F.lit(0).cast("long")).alias("tag")).collect()
    placed = []
    for b in range(buckets):
        own = [r.doc_id for r in sorted(rows, key=lambda r: r.tag) if r.tag % buckets == b]
        rng = np.random.Generator(np.random.PCG64([12, b]))
        draws = rng.integers(0, np.arange(len(own), 0, -1))
        for k, drawn in zip(range(len(own) - 1, -1, -1), draws):
            own[k], own[drawn] = own[drawn], own[k]
        placed += own
    found = sharding.sharded(docs, 40, bucket_bytes=50_000).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in found] == placed


def test_shards_of_odd_rows(spark, odd, none):
    held(odd, sharding.sharded(odd, 40, bucket_bytes=1000), 40)
    held(odd, sharding.sharded(odd, 200), 200)
    out = sharding.sharded(none, 40)
    assert out.collect() == [] and "shard" in out.columns


def test_a_key_of_many_rows_is_dealt_out(spark):
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    dealt = sharding._dealt(docs, "doc_id", "text", 12)
    sizes = [r["count"] for r in dealt.groupBy(F.pmod("tag", F.lit(30))).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 1300
    held(docs, sharding.sharded(docs, 40, bucket_bytes=30_000), 40)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, [5, k])) for k in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def plain_whitening(vectors):
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    apart = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in apart) / n**3 for j in range(d)] for i in range(d)])
    values, found = np.linalg.eigh(v)
    values, found = values[::-1], found[:, ::-1]
    return n, [sum(a * a for a in r) for r in apart], (np.array(apart) / n) @ found / np.sqrt(values), values / np.trace(v)


def test_whitening_matches_plain(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    df = spark.createDataFrame(rows.selectExpr("vec_id", "slice(embedding, 1, 12) AS embedding").collect()).repartition(4)
    kept = {r.vec_id: r.embedding for r in df.collect()}
    ids = sorted(kept)
    n, deviation, white, explained = plain_whitening([kept[k] for k in ids])
    fitted = whitening.fit(whitening.usable(df, "embedding"), "embedding")
    found = whitening.whitened(df, "embedding", fitted, 32)
    by_id = {r.vec_id: r for r in found.collect()}
    assert fitted.n == n and [by_id[k].deviation for k in ids] == deviation
    ours = np.array([by_id[k].whitened for k in ids])
    assert np.allclose(np.abs(ours), np.abs(white), rtol=1e-6, atol=1e-9)
    assert np.allclose(fitted.values / fitted.trace, explained, rtol=1e-9)
    assert whitening.identity_error(found) < 1e-9
    assert np.allclose(ours.T @ ours / n, np.eye(12), atol=1e-9)


def test_popcounts_are_exact(spark):
    """Entries of very different size, and blocks that end inside a word."""
    rng = np.random.default_rng(3)
    values = (rng.standard_normal((333, 3)) * [1e-1, 1e4, 1e12]).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "vec_id long, v array<double>").repartition(3)
    n, deviation, white, explained = plain_whitening(values)
    fitted = whitening.fit(df, "v")
    assert np.allclose(fitted.values / fitted.trace, explained, rtol=1e-6)
    found = {r.vec_id: r.deviation for r in whitening.whitened(df, "v", fitted, 2).collect()}
    assert all(found[k] == (x if x < 1 << 63 else None) for k, x in enumerate(deviation))


def test_whitening_of_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 3), float(k % 5), 1.0], 4, "x") for k in range(30)]
    odd = [(90, None, 1, None), (91, [1.0, None, 2.0], 1, None), (92, [1.0, nan, 2.0], 1, None), (93, [inf, 0.0, 0.0], 1, None), (94, [], 1, None),
           (95, [1.0], 1, None), (None, [1.0, 2.0, 1.0], 1, "null id"), (3, [0.0, 3.0, 1.0], 1, "again")]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, deviation int, whitened string")
    over(monkeypatch, df)
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    assert {r.n for r in rows} == {32} and {r.component for r in rows} == {1, 2} and len(rows) == 64
    assert all(r.identity_error < 1e-9 for r in rows)
    for few in ([], [(1, [1.0, 2.0], 1, None)] * 3, odd[:5]):
        over(monkeypatch, spark.createDataFrame(few, df.schema))
        assert QUERIES["op13_whitening"](spark, SF).collect() == []
