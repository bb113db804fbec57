"""Each training-data operator against a plain version, and its edge cases."""

import pickle
import random
import re
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import plain  # noqa: E402

from spanwise.llm import bpe, decontaminate, language, licenses, secrets, simhash, sketch, substrings, token_counts, toxicity  # noqa: E402
from spanwise.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit_items string, score string"
LONG = "Some words that go on and on, again. " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    rows = [
        (None, None, None, None, None, None, None), (1, "", "en", "a", 0, "x", "y"), (2, None, "en", "a", None, "x", "y"),
        (3, "one", "en", None, 3, None, None), (3, "one", "en", None, 3, None, None), (4, "!!! ...", None, "b", 7, None, None),
        (5, LONG, "en", "a", len(LONG), None, None), (6, LONG, "fr", "a", len(LONG), None, None), (None, "one two three four five six", "en", "c", 27, None, None),
        (7, "ünïcödé \U0001f600 text \x00 and\ttabs", "de", "c", 10, None, None), (7, "another text with the same id", "de", "c", 10, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_secrets_match_plain(spark):
    found = result(spark, "op1_secret_scan")
    for doc, text in texts(spark).items():
        counts, listed = plain.secrets_row(text)
        assert [found[doc].n_assign, found[doc].n_access, found[doc].n_hex] == counts
        assert found[doc].base_sha256 == plain.sha(listed)


def test_secret_spans(spark):
    mixed = "Ab3dE" * 6
    rows = [
        "token:secret:abcdefghijklmno", "API_KEY = 'abcdefghijkl' apikey=abcdefghijk", "x" * 300 + "AKIAABCDEFGHIJKLMN" + "0123456789abcdef0",
        f"{mixed} alone", f"login = someone\nkey {mixed}", f"login = someone\n\n{mixed}", f"login = someone{' ' * 300}{mixed}",
        " ".join(f"deadbeefdeadbeef{k:04x}" for k in range(600)), "\U0001f600 password=\"0123456789ab\"",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    for k, text in enumerate(rows):
        spans = sorted((s.start, n, s.end) for n, kind in enumerate(secrets.BASE) for s in found[k][kind])
        assert spans == plain.base_spans(text)
    assert [len(found[k].weak) for k in (3, 4, 5, 6)] == [0, 1, 0, 0]
    assert [len(found[k].ident) for k in (3, 4, 5, 6)] == [0, 1, 0, 0]


def test_text_is_no_complement_of_itself(spark):
    url, mixed = "https://example.com/Blog/2024/SomeArticleTitle", "Ab3dE" * 6
    rows = [f"see {url} for more", f"user = {mixed}", f"see {url} and {mixed} there", f"login = someone {url}", f"{mixed} and {url}"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [len(r.ident), len(r.weak), len(r.endpoint)] for r in secrets.scan(df).collect()}
    # An address and a mixed string link only beside an access identifier; a mixed string in an address is part of it.
    assert found == dict.fromkeys(range(5), [0, 0, 0])
    assert secrets.redacted(df.where("doc_id = 0")).first().text == rows[0]


def test_three_parts_link_and_ordinary_addresses_stay(spark):
    one, two, mixed = "https://example.com/Blog/2024/SomeArticleTitle", "https://example.org/Docs/2023/OtherArticlePage", "Ab3dE" * 6
    rows = [
        f"See {one} and {two} for more.", f"login = someone {one} {mixed}", f"login = someone {one} {two}", f"AKIA{'Z' * 16} at {one} with {mixed}",
        f"login = someone\n\n{one} {mixed}", f"login = someone {'deadbeef' * 3} {'. ' * 100}{one}", f"build {mixed} see {one}",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [len(r.ident), len(r.weak), len(r.endpoint)] for r in secrets.scan(df).collect()}
    assert found == {0: [0, 0, 0], 1: [1, 1, 1], 2: [0, 0, 0], 3: [0, 1, 1], 4: [0, 0, 0], 5: [1, 0, 0], 6: [0, 0, 0]}
    text = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert [text[k] for k in (0, 2, 4, 6)] == [rows[k] for k in (0, 2, 4, 6)]
    assert text[1] == "[secret] [secret] [secret]"


def test_linked_spans_and_redaction_match_plain(spark):
    chance = random.Random(17)
    bits = ["login = someone", "user: x1234", "https://example.com/a/b", "host=db.local:99", "Ab3dE" * 5, "deadbeef" * 3, "AKIA" + "Q" * 16, "token = abcdefghijklmn"]
    bits += ["\n\n", "\n \t\n", "word", "\U0001f600 é", " " * 90, "x" * 120, "https://example.com/" + "Ab3dE" * 6, "/", "-"]
    rows = ["".join(chance.choice(bits) + chance.choice([" ", " ", "", "\n"]) for _ in range(chance.choice([1, 4, 12, 60, 400]))) for _ in range(150)]
    rows += [t or "" for t in texts(spark).values()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    text = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    linked = 0
    for k, row in enumerate(rows):
        want = plain.linked_spans(row)
        assert {kind: [(s.start, s.end) for s in found[k][kind]] for kind in secrets.KINDS} == want
        assert text[k] == plain.masked(row, [s for spans in want.values() for s in spans])
        linked += sum(len(want[kind]) for kind in secrets.KINDS[3:])
    assert linked > 100


def test_very_many_secrets_in_one_text(spark):
    n = 200_000
    row = "".join(f"k{k:07d} deadbeefdeadbeef{k % 65536:04x}\n" for k in range(n))
    df = spark.createDataFrame([(1, row)], "doc_id long, text string")
    start = time.monotonic()
    new = secrets.redacted(df).first().text
    assert new == re.sub("deadbeef[0-9a-f]+", "[secret]", row)
    assert time.monotonic() - start < 60


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "a token = 0123456789abcdef0123 b password: abcdefghijklmnop", 5), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in secrets.redacted(df).collect()}
    assert found[1].text == "a [secret] b [secret]" and found[1].n_chars == 21
    assert (found[2].text, found[2].n_chars, found[3].text) == ("clean", 5, None)
    assert secrets.redacted(odd).columns == odd.columns
    assert secrets.redacted(odd).where("doc_id = 5").first().text == LONG


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = QUERIES["op2_language_id"](spark, SF).where("held_out").collect()
    assert sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edges(spark, odd, none):
    found = language.identify(odd, odd).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found if r.text is None or not any(map(str.isalpha, r.text))} == {"und"}
    assert language.identify(none, none).count() == 0
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def test_contamination_matches_plain(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = plain.item_windows(items)
    found = result(spark, "op4_decontamination")
    for doc, text in texts(spark).items():
        r = found[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain.contamination(text, windows)
    assert any(r.contaminated for r in found.values())


def test_contamination_of_short_and_repetitive_items(spark):
    chance = random.Random(5)
    pool = ["a", "b", "c", "é"]
    text = lambda n: " ".join(chance.choice(pool) for _ in range(n))
    items = [(k, text(chance.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for k in range(2, 12)] + [(1, None), (2, "same id"), (None, "a b c a b c a"), (3, "")]
    items = [i for i in items if i[1] is None or len(i[1].split()) > 2]
    docs = [(k, text(400)) for k in range(30)] + [(99, "A, b;C a\nB--c a")]
    found = decontaminate.find_benchmark(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=60
    ).withColumn("n_hit", decontaminate.hit_words()).collect()
    windows = plain.item_windows(items)
    for r in found:
        want = plain.contamination(r.text, windows)
        assert (r.n_words, r.n_hit, len(r.hit_items), plain.sha(",".join(r.hit_items))) == want


def test_contamination_edges(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark(odd, empty).where(F.size("hit_spans") > 0).count() == 0
    one = spark.createDataFrame([(1, "go on and on again some words that")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_benchmark(odd, one).where(F.size("hit_items") > 0).collect()} == {5, 6}
    assert decontaminate.clean_documents(odd, one).columns == odd.columns
    assert decontaminate.find_benchmark(none, one).count() == 0


def test_simhash_matches_plain(spark):
    rows = [(d, plain.simhash(t)) for d, t in texts(spark).items()]
    component = plain.simhash_components(rows)
    found = result(spark, "op5_simhash_dedup")
    for doc, fp in rows:
        assert found[doc].fingerprint == f"{fp:016x}"
        assert found[doc].component_id == component[fp]


@pytest.mark.parametrize("hot", [simhash.HOT, 5])
def test_simhash_links_of_dense_groups(spark, hot):
    chance = random.Random(7)
    fps = set()
    for _ in range(6):
        at = chance.getrandbits(64)
        for _ in range(60):  # a walk, so that components are long and hubs do not reach all members
            for b in chance.sample(range(64), chance.choice([1, 2, 3])):
                at ^= 1 << b
            fps.add(at)
    signed = [(f - (1 << 64) if f >> 63 else f, 1) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, n long"), hot=hot)
    roots = {r.node % (1 << 64): r.root for r in simhash.components(edges).collect()}
    want = plain.simhash_components([(k, f) for k, f in enumerate(sorted(fps))])
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_cuts_are_whole():
    """Four classes share out all coordinates, and each narrows every grid."""
    first, second = simhash._cuts()
    for cut in (first, second):
        assert sum(cut) == (1 << 64) - 1 and not any(a & b for a in cut for b in cut if a != b)
    for grid in simhash._grids():
        assert all(a & ~grid for a in first) and all(b & ~(grid | a) for a in first for b in second)


def test_one_of_each(spark, odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 4, 5, 7, 7] and ids.count(None) == 1
    assert simhash.one_of_each(none).count() == 0
    assert simhash.membership(odd).count() == odd.count()


def test_toxicity(spark):
    rows = [(k, f"the quiet words of number {k} go by" + (" you scum" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.scored(df, df, df)
    assert all((r.score >= 0.5) == bool(r.toxic) for r in found.collect())


def test_toxicity_of_neutral_mentions(spark):
    """Toxic rows name one group more often; the swap penalty keeps the name itself from counting."""
    chance = random.Random(3)
    rows = []
    for k in range(600):
        toxic = k % 4 == 0
        group = "muslims" if chance.random() < (0.8 if toxic else 0.2) else "christians"
        rows.append((k, f"{group} met today" + (" worthless trash" if toxic and k % 8 else ""), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(1, "muslims met today"), (2, "christians met today")], "doc_id long, text string")
    a, b = (r.score for r in toxicity.scored(probe, df, df).orderBy("doc_id").collect())
    free, toxicity.COUNTERFACTUAL = toxicity.COUNTERFACTUAL, 0.0
    try:
        c, d = (r.score for r in toxicity.scored(probe, df, df).orderBy("doc_id").collect())
    finally:
        toxicity.COUNTERFACTUAL = free
    assert abs(a - b) < 0.3 * abs(c - d) and a < 0.5


def test_toxic_words_of_long_texts_teach(spark):
    """The word that tells has the largest hash bucket of a text of 100,000 words."""
    filler = sorted((f"w{k}" for k in range(100_000)), key=lambda w: toxicity.bucket(w.encode()))
    top = toxicity.bucket(filler[-1].encode())
    told = next(w for w in (f"zz{k}" for k in range(10**7)) if toxicity.bucket(w.encode()) > top)
    rows = [(k, " ".join(filler) + (f" {told}" if k % 2 else ""), k % 2) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(1, f"a {told}"), (2, "a b")], "doc_id long, text string")
    a, b = (r.score for r in toxicity.scored(probe, df, df).orderBy("doc_id").collect())
    assert a > 0.6 > b


def test_swap_penalty_matches_rewritten_texts():
    chance = random.Random(4)
    names = [t for kind in toxicity.IDENTITY_TERMS for t in kind]
    pool = names[:12] + ["met", "today", "you", "scum"]
    buckets = sorted({toxicity.bucket(w.encode()) for w in pool[3:]})  # some terms have no weight
    column = {b: k for k, b in enumerate(buckets)}
    lines = [[chance.choice(pool) for _ in range(chance.choice([1, 3, 8, 20]))] for _ in range(60)]
    rows = [{toxicity.bucket(w) for w in toxicity.distinct_words(" ".join(line))} for line in lines]
    penalty = toxicity.swap_penalty(rows, column)
    for _ in range(5):
        w = [chance.uniform(-2, 2) for _ in buckets]
        score = lambda line: sum(w[column[b]] for b in {toxicity.bucket(x.encode()) for x in line} if b in column)
        want = 0.0
        for line in lines:
            for kind in toxicity.IDENTITY_TERMS:
                for a in set(line) & set(kind):
                    for b in set(kind) - {a}:
                        want += (score([b if x == a else x for x in line]) - score(line)) ** 2
        got = sum(penalty[i, j] * w[i] * w[j] for i in range(len(w)) for j in range(len(w)))
        assert abs(got - want) < 1e-6 * max(want, 1)


def test_toxicity_of_held_out_rows(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic IS NOT NULL").collect()}
    found = [r for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").collect() if r.doc_id in toxic]
    assert found and sum(r.predicted == toxic[r.doc_id] for r in found) >= 0.9 * len(found)


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.scored(odd, odd, labels).collect())
    assert toxicity.scored(odd, odd, labels.limit(0)).count() == odd.count()
    assert toxicity.scored(none, none, labels).count() == 0


def test_edited_halves(spark):
    docs = texts(spark)
    ids = sorted(docs)
    found = result(spark, "op7_fingerprints")
    for k, doc in enumerate(ids):
        text, other = docs[doc] or "", docs[ids[(k + 1) % len(ids)]] or ""
        assert found[doc].edited_sha256 == plain.sha(plain.edited_half(text, other))
        assert found[doc].n_chars == len(text) and 0 <= found[doc].near_edited <= 1
        if text == other:
            assert found[doc].fingerprint == found[ids[(k + 1) % len(ids)]].fingerprint and found[doc].near_next == 1
    long = [r for r in found.values() if r.n_chars > 2000]
    assert 0.3 < sum(r.near_edited for r in long) / len(long) < 0.8 and sum(r.near_next for r in long) / len(long) < 0.1


def test_sketch_edges(spark, odd, none):
    assert sketch.edited_halves(odd).count() == odd.count()
    assert sketch.edited_halves(none).count() == 0
    one = sketch.edited_halves(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited == "abcabc"


def test_sketch_merges(spark):
    """The sketch of two documents together comes from their sketches; containment of a part is near one."""
    words = [f"w{k}" for k in range(4000)]
    df = spark.createDataFrame([(1, " ".join(words), " ".join(words[:500]))], "doc_id long, text string, part string")
    df = sketch.with_sketch(sketch.with_sketch(df, "text", "a"), "part", "b")
    r = df.select("a", "b", sketch.likeness("a", "b").alias("near")).first()
    assert r.near == 1 and set(h for h in r.b.kept if h < sketch.threshold()) <= set(r.a.kept)


def test_bpe_matches_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    found = result(spark, "op8_bpe")
    for doc, text in texts(spark).items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (found[doc].n_tokens, found[doc].ids_sha256) == (len(ids), plain.sha(",".join(map(str, ids))))
        assert found[doc].decoded_sha256 == plain.sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_on_hard_texts():
    library = Tokenizer.from_file(VOCABULARY)
    vocabulary = bpe.Vocabulary.read(VOCABULARY)
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    chance = random.Random(11)
    hard = ["", " ", "  a  b \n\n c", "<|endoftext|>x <|endoftext|><|endo", "'ll 'LL don't", "a" * 5000, "\x1c\x1d a\x85b\xa0c d", LONG[:5000]]
    hard += ["".join(chance.choice("ab ntheiro'\n1é中😀\x00") for _ in range(300)) for _ in range(200)]
    hard += ["".join(map(chr, range(k, k + 64))) for k in range(0x20, 0x3000, 64)]
    for text in hard:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, repr(text)
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode([99, 10**6, -1]) == decoder.decode([99])


def test_a_pre_token_of_many_megabytes_stays_within_memory():
    code = (
        "import resource, sys; from spanwise.llm import bpe; v = bpe.Vocabulary.read(sys.argv[1]); e = bpe.Encoder(v); d = bpe.Decoder(v)\n"
        "text = '=' * 20_000_000; ids = e.encode(text); assert d.decode(ids) == text\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    )
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code, VOCABULARY], cwd=root, capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout.split()[-1]) < 1024


def test_long_pre_tokens_match_library():
    library = Tokenizer.from_file(VOCABULARY)
    encoder = bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    chance = random.Random(19)
    for text in ["=" * 50_001, "".join(chance.choice("abeinrst") for _ in range(30_000)), "".join(chance.choice("=-*é") for _ in range(20_000))]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_edges(spark, odd, none):
    assert all(r.decoded == (r.text or "") for r in bpe.tokenized(odd, VOCABULARY).collect())
    assert bpe.tokenized(none, VOCABULARY).count() == 0
    shared = bpe.share(spark, VOCABULARY)
    again = bpe.tokenized(odd, VOCABULARY).withColumn("again", bpe.decode(bpe.encode(F.col("text"), shared), shared))
    assert again.where("NOT decoded <=> again").count() == 0


def test_edited_counts():
    encoder = bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    chance = random.Random(13)
    for _ in range(400):
        text = "".join(chance.choice("ab c'l ldn \n\n1é?") for _ in range(chance.choice([0, 1, 5, 80])))
        pieces = bpe.pre_tokens(text)
        tree = token_counts.Tree([len(p) for p in pieces], [len(encoder.known[p]) for p in pieces])
        for _ in range(4):
            start = chance.randint(0, len(text))
            end = min(len(text), start + chance.choice([0, 0, 1, 3, 20]))
            new = "".join(chance.choice("ab 'lé\n") for _ in range(chance.choice([0, 1, 2, 9])))
            text, _ = token_counts.edit(tree, encoder, text, start, end, new)
            assert tree.tokens[1] == sum(len(encoder.known[p]) for p in bpe.pre_tokens(text))
            assert tree.chars[1] == len(text)


def test_token_counts_query(spark):
    library = Tokenizer.from_file(VOCABULARY)
    found = result(spark, "op3_token_counts")
    for doc, text in texts(spark).items():
        assert found[doc].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
        assert found[doc].n_encoded_again <= 80
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("end"), F.lit("xyz").alias("text")))
    for r in token_counts.edited_counts(spark.read.parquet(f"{SF}/documents.parquet"), edits, VOCABULARY).collect():
        text = r.text or ""
        want = text[:2] + "xyz" + text[max(2, 9):]
        assert r.edited.text == want
        assert r.edited.n_tokens == len(library.encode(want, add_special_tokens=False).ids)


def test_token_count_edges(spark, odd, none):
    null = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    assert token_counts.edited_counts(odd, null, VOCABULARY).where("n_tokens <> edited.n_tokens").count() == 0
    assert token_counts.edited_counts(none, null, VOCABULARY).count() == 0
    stored = token_counts.edited_counts(odd, null, VOCABULARY)
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("new ").alias("text")))
    shared = bpe.share(spark, VOCABULARY)
    again = stored.withColumn("again", token_counts.recount(F.col("text"), F.col("leaves"), edits, shared))
    direct = token_counts.edited_counts(odd, edits, VOCABULARY)
    assert sorted(r.again.n_tokens for r in again.collect()) == sorted(r.edited.n_tokens for r in direct.collect())


def test_substrings_match_plain(spark):
    seen, want = {}, set()
    for doc, text in sorted(texts(spark).items()):
        units = {}
        for grain in substrings.GRAINS:
            for m in grain.finditer(text or ""):
                words = m[0].lower().split()
                if len(words) >= substrings.MIN_WORDS:
                    units.setdefault((" ".join(words), m.end() - len(m[0].lstrip())), (m.start(), m.end()))
        for (words, _), (start, end) in sorted(units.items(), key=lambda x: x[1]):
            if words in seen:
                want.add((doc, start, end, *seen[words]))
            else:
                seen[words] = (doc, start)
    found = {tuple(r) for r in QUERIES["op9_substring_dedup"](spark, SF).collect()}
    assert found == want and want


def test_substring_edges(spark, odd, none):
    assert substrings.repeated_units(none).count() == 0
    df = spark.createDataFrame([(2, "Keep me. One two three four five six seven!\nEnd", 1), (1, "one  two three FOUR five six seven! Yes.", 2), (None, None, 3)], "doc_id long, text string, removed int")
    found = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert found[2].cleaned == "Keep me.End" and found[1].cleaned == found[1].text and len(found) == 3
    assert substrings.without_repeats(odd).count() == odd.count()


def test_a_passage_pasted_into_sentences_or_broken_anew_is_found(spark):
    passage = "end of one, the second part has seven words in it, and here begins. The whole sentence of this passage stands alone. Then the last"
    rows = [(1, f"Some start {passage} goes on."), (2, f"Another one {passage} stops."), (3, passage.replace("whole sentence", "whole\nsentence"))]
    found = {r.doc_id: r.cleaned for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == rows[0][1]
    assert found[2] == "Another one end of one, and here begins. Then the last stops."
    assert "seven words" not in found[3] and "stands alone" not in found[3]


def test_scripts_without_spaces_have_units(spark):
    chinese = "这是一个没有空格的句子用来测试重复的段落是否会被发现"
    thai = "ข้อความภาษาไทยนี้ไม่มีช่องว่างระหว่างคำ"
    rows = [(1, f"前面。{chinese}。后面"), (2, f"别的！{chinese}。不同"), (3, thai), (4, thai), (5, "短句。"), (6, "短句。")]
    found = {(r.doc_id, r.kept_doc_id) for r in substrings.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2, 1), (4, 3)}


def test_lines_and_paragraphs_of_short_sentences_are_found(spark):
    shouted = "TO.!! EDHEEA!! ONLYND!! WE.!! GO.!! HOME NOW!!"
    items = "- red\n- blue\n- green\n- black"
    short = "He came. She left.\n\nIt rained. They ran."
    rows = [
        (1, f"First one.\n{shouted}\nIts end."), (2, f"Second one.\n{shouted}\nAnother end."), (3, f"Top.\n\n{items}\n\nDone."),
        (4, f"Head.\n \n{items}\n\nOver."), (5, short), (6, short),
    ]
    found = {r.doc_id: r.cleaned for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k] == dict(rows)[k] for k in (1, 3, 5))
    assert (found[2], found[4], found[6]) == ("Second one.\nAnother end.", "Head.\n \nOver.", "")


def test_passages_match_plain(spark):
    seen, want = {}, set()
    for doc, text in sorted(texts(spark).items()):
        text, units = text or "", {}
        cuts = {(m.start(), m.end()) for g in substrings.GRAINS for m in g.finditer(text)} | {(0, len(text))}
        for border in (r"\n+", r"\n[ \t\r]*\n\s*"):
            ends = [m.end() for m in re.finditer(border, text)]
            cuts |= {(a, b) for a, b in zip([0, *ends], [*ends, len(text)]) if a < b}
        for start, end in sorted(cuts):
            words = text[start:end].lower().split()
            if len(words) >= substrings.MIN_WORDS:
                units.setdefault((" ".join(words), end - len(text[start:end].lstrip())), set()).add((start, end))
        for (words, at), spans in units.items():
            seen.setdefault(words, []).append((doc, at, spans))
    for words, places in seen.items():
        want |= {(doc, at, words) for doc, at, _ in sorted(places, key=lambda p: (p[0], min(p[2])))[1:]}
    text = texts(spark)
    found = set()
    for r in QUERIES["op9_passage_dedup"](spark, SF).collect():
        unit = text[r.doc_id][r.start : r.end]
        found.add((r.doc_id, r.end - len(unit.lstrip()), " ".join(unit.lower().split())))
    assert found == want and want


def test_licenses(spark, odd, none):
    filler = " ".join(f"word{k}" for k in range(100))
    rows = [(k, f"{filler} {text} {filler}") for k, text in enumerate(licenses.TEMPLATES.values())] + [(50, filler), (51, None), (52, "Released under the MIT License.")]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for k, name in enumerate(licenses.TEMPLATES):
        spans = [(r.word_start, r.word_end) for r in found if r.doc_id == k and r.license == name]
        assert len(spans) == 1 and spans[0][0] == 100
    assert {r.doc_id for r in found} == {*range(len(licenses.TEMPLATES)), 52}
    assert licenses.find_licenses(odd).count() == 0 and licenses.find_licenses(none).count() == 0


def test_notices_and_bodies_of_common_licenses(spark):
    filler = " ".join(f"word{k}" for k in range(50))
    body = " ".join(licenses.TEMPLATES["gpl-3.0-text"].split())
    rows = ["Licensed under CC BY-SA 4.0.", "the Mozilla Public License, Version 2.0", "under the ISC License", "CC0 1.0 Universal", body, "GNU General Public License, version 2"]
    df = spark.createDataFrame([(k, f"{filler} {x} {filler}") for k, x in enumerate(rows)], "doc_id long, text string")
    found = licenses.find_licenses(df).collect()
    names = {k: {r.license for r in found if r.doc_id == k} for k in range(len(rows))}
    assert [names[k] for k in (0, 1, 2, 3, 5)] == [{"cc-by-sa-4.0"}, {"mpl-2.0"}, {"isc"}, {"cc0-1.0"}, {"gpl-2.0"}]
    assert [(r.word_start, r.containment) for r in found if r.license == "gpl-3.0-text"] == [(50, 1.0)]


def test_licenses_match_plain(spark):
    import re

    want = set()
    for doc, text in texts(spark).items():
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        for name, template in licenses.TEMPLATES.items():
            t = [w for w in re.split(r"[^\w]+|_", template.lower()) if w]
            if any(words[k : k + len(t)] == t for k in range(len(words))):
                want.add((doc, name))
    found = {(r.doc_id, r.license) for r in QUERIES["op10_license_scan"](spark, SF).collect()}
    assert found >= want and want


def test_fingerprint_of_few_words_of_which_one_fills_a_piece():
    import xxhash

    text = "x" * (5 << 20) + " b"
    assert simhash.fingerprint_of(text) & (1 << 64) - 1 == xxhash.xxh64_intdigest(text, 42)


def test_pipeline_keeps_what_a_plain_version_keeps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    prints = [(d, plain.simhash(t)) for d, t in kept.items()]
    component = plain.simhash_components(prints)
    firsts = {d for d, fp in prints if component[fp] == d}
    windows = plain.item_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    want = {d for d in firsts if plain.contamination(kept[d], windows)[1] == 0}
    left = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(left) == want and len(want) < len(firsts) < len(kept)
    library = Tokenizer.from_file(VOCABULARY)
    untouched = {r.doc_id for r in secrets.redacted(clean).collect() if r.text == kept[r.doc_id]}
    for d in want & untouched:
        assert left[d].n_tokens == len(library.encode(kept[d] or "", add_special_tokens=False).ids)


def split_words(text):
    return decontaminate.fold(text.encode()).split()


def test_pattern_tables_are_flat():
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    words = [letters[rng.integers(0, 26, k)].tobytes().decode() for k in rng.integers(3, 9, 40_000)]
    items = [(str(k), " ".join(words[j] for j in rng.integers(0, len(words), 200))) for k in range(800)]
    items += [("again", items[3][1]), (None, "only here and nowhere else"), ("one", "single"), ("none", None)]
    known = decontaminate.patterns(items)
    size = sum(len(text or "") for _, text in items)
    assert len(pickle.dumps(known, protocol=5)) < 16 * size
    ours, owners, spans = split_words("x y " + items[3][1] + " z only here and nowhere else single"), set(), []
    for table in known.tables:
        table.search(known.text, ours, 0, spans, owners)
    assert {known.names[k] for k in owners} == {"3", "again", "one"}
    assert sorted(spans) == [(2, 202), (203, 208), (208, 209)]
    long = [("long", " ".join(f"w{k}" for k in range(600)))]
    wide = decontaminate.patterns(long, 400)
    spans = []
    wide.tables[0].search(wide.text, split_words("a " * 700 + long[0][1] + " b"), 0, spans, set())
    assert spans == [(700, 1300)]
