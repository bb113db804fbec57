"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches merge by union and the overlap of
two of them estimates containment however unequal the documents are. Texts with few hashes below the threshold keep their
``FLOOR`` smallest hashes as well, which merges the same way; two sketches are compared below the lower of the two bounds
up to which they are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash in so many lies below the threshold.
SCALE = 16
FLOOR = 16
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def threshold(scale: int = SCALE) -> int:
    return _LOWEST + (1 << 64) // scale


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; of the whole sequence where it is shorter; none without words."""
    n = F.size(words)
    runs = F.transform(F.slice(words, F.lit(1), n - size + 1), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """``df`` with ``out``: the sorted hashes ``kept``, and ``bound``, the hash up to which they are all there.

    Words are lower-cased and parted by white space. Null, empty and blank texts have an empty sketch with the highest bound.
    """
    df = df.withColumn("__words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != ""))
    df = df.withColumn("__hashes", shingle_hashes(F.col("__words"), SHINGLE)).drop("__words")
    df = df.withColumn("__below", F.array_distinct(F.filter("__hashes", lambda h: h < threshold(scale))))
    df = df.withColumn("__all", F.when(F.size("__below") < FLOOR, F.array_sort(F.array_distinct("__hashes"))))
    few = F.slice("__all", 1, FLOOR)
    kept = F.when(F.col("__all").isNull(), F.array_sort("__below")).otherwise(few)
    bound = F.when(F.col("__all").isNull(), F.lit(threshold(scale) - 1)).when(F.size("__all") <= FLOOR, F.lit(_HIGHEST)).otherwise(
        F.greatest(F.element_at(few, -1), F.lit(threshold(scale) - 1))
    )
    return df.withColumn(out, F.struct(kept.alias("kept"), bound.alias("bound"))).drop("__hashes", "__below", "__all")


def written(sketch: str) -> Column:
    """The sketch as text: hexadecimal bound and hashes."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(digits(F.col(sketch)["bound"]), F.lit(":"), F.array_join(F.transform(F.col(sketch)["kept"], digits), ","))


def likeness(a: str, b: str) -> Column:
    """Estimated share of the smaller document's shingles that the larger has; two empty ones are alike, an empty one and another not."""
    bound = F.least(F.col(a)["bound"], F.col(b)["bound"])
    left, right = (F.filter(F.col(x)["kept"], lambda h: h <= bound) for x in (a, b))
    less = F.least(F.size(left), F.size(right))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).when(less == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / less
    )


def _block(splits: list[int], x: Column) -> Column:
    """How many of the splits are at most ``x``, by binary search in a constant array."""
    if not splits:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << k) for k in range(len(splits).bit_length() - 1, -1, -1)))
    values = F.array(*(F.lit(s).cast("long") for s in splits))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(splits)) & (F.get(values, at + step - 1) <= x), at + step
    ).otherwise(at))


def with_next(df: DataFrame, columns: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows by ascending doc_id (null first, ties by text); after the last comes the first.

    Rows are cut into blocks of ids at approximate quantiles and shuffled once. Each block also gets the first rows of the
    block behind it, so no window goes over the whole table.
    """
    spark = df.sparkSession
    blocks = blocks or 4 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)))
    ids = df.select("__id")
    found = ids.agg(F.percentile_approx("__id", [k / blocks for k in range(1, blocks)], 20 * blocks).alias("q")).first().q
    splits = sorted(set(found or []))
    df = df.withColumn("__block", _block(splits, F.col("__id")))
    firsts = ids.withColumn("__block", _block(splits, F.col("__id"))).groupBy("__block").agg(F.min("__id").alias("first")).orderBy("__block").collect()
    if not firsts:
        first, before = F.lit(None).cast("long"), F.lit(0)
    else:
        by_block = {r["__block"]: (r["first"], firsts[k - 1]["__block"]) for k, r in enumerate(firsts)}
        line = [by_block.get(k, (None, None)) for k in range(len(splits) + 1)]
        first = F.get(F.array(*(F.lit(x).cast("long") for x, _ in line)), F.col("__block"))
        before = F.get(F.array(*(F.lit(x).cast("int") for _, x in line)), F.col("__block"))
    own = F.struct(F.col("__block").alias("block"), F.lit(False).alias("ahead"))
    df = df.withColumn("__at", F.explode(F.when(
        F.col("__id") == first, F.array(own, F.struct(before.alias("block"), F.lit(True).alias("ahead")))
    ).otherwise(F.array(own))))
    order = W.partitionBy(F.col("__at.block")).orderBy(F.col("__at.ahead"), "__id", "text")
    df = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return df.where(~F.col("__at.ahead")).drop("__id", "__block", "__at")


def edited_halves(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``n_chars``, ``edited`` text, and the sketches ``own``, ``edited_sketch``, ``next_own``.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document. A null
    text is an empty one. Repeated rows are each a document of their own; a single row is its own next.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = with_next(with_sketch(df, "text", "own"), ["text", "own"])
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("__half", F.floor(F.col("n_chars") / 2).cast("int"))
    df = df.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("__half")), F.substring(F.col("next_text"), F.lit(1), F.col("__half"))
    )).drop("text", "next_text", "__half")
    return with_sketch(df, "edited", "edited_sketch")
