"""Global shuffle into shards: a two-pass external shuffle.

The first pass scatters the records into buckets by a seeded hash of their key, so many that one fits into a task's memory.
The second takes each bucket, shuffles it by Fisher and Yates with a generator seeded by the bucket, and writes it.
The buckets laid end to end are the shuffled table, which is cut into shards whose counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.buckets import chunk
from spanwise.operators.ordered import running_sums
from spanwise.session import materialize, scratch_path

#: Bytes of records in a bucket, on average.
BUCKET_BYTES = 32 << 20
#: Rows of one key that may lie in one bucket; of a key with more rows, each is dealt by itself.
SPLIT = 1000
#: Tasks of the second pass; beyond it a task takes several buckets, one after the other.
MOST_TASKS = 50_000
#: Bytes that a record counts besides its text.
OVERHEAD = 16


def record_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of n places; each exchange draws from the places not yet settled."""
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1)) if n else []
    order = list(range(n))
    for k, drawn in zip(range(n - 1, -1, -1), draws):
        order[k], order[drawn] = order[drawn], order[k]
    return np.array(order, dtype=np.int64)


def _dealt(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """Rows as ``row`` with ``tag``, the seeded hash of the key that deals them, and what orders rows of one key."""
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("string").alias("key"), F.crc32(F.col(text).cast("binary")).alias("crc"),
                       record_size(text).alias("size"), F.lit(0).cast("long").alias("copy"))
    repeated = docs.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("key")
    if not repeated.isEmpty():
        # Written once, so that the rows keep their numbers however often tasks are run again.
        many = repeated.withColumn("many", F.lit(True)).withColumnRenamed("key", "other")
        marked = rows.join(many, F.col("key").eqNullSafe(F.col("other")), "left")
        rows = materialize(marked.withColumn("copy", F.when(F.col("many"), F.monotonically_increasing_id()).otherwise(0)).drop("many", "other"), "dealt")
    return rows.withColumn("tag", F.xxhash64(F.lit(seed), "key", "copy")).drop("key", "copy")


def sharded(docs: DataFrame, shards: int, path: str | None = None, key: str = "doc_id", text: str = "text", seed: int = 12,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows of ``docs`` to ``path``, shuffled, in folders ``shard=0`` and up; the written rows, read back.

    Added columns: ``shard`` and ``slot``, the place in the shard, gapless from 0 and ascending within each file; columns
    of these names are replaced. The same rows and seed give the same shards however the input is cut into files, unless a
    key repeats more than SPLIT times: such rows are dealt by their place in the input. Repeated rows are shuffled like others, a
    null key is a key, a null text counts no bytes. Fewer rows than shards leave shards empty. A record is never cut.
    """
    rows = _dealt(docs.drop("shard", "slot"), key, text, seed)
    n, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("tag", F.lit(buckets)))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = running_sums(counts, [], chunk(F.col("bucket"), 1000), [F.col("bucket")], {"upto": "n"})
    starts = starts.select(F.col("bucket").alias("of"), (F.col("upto") - F.col("n")).alias("start"))
    schema = T.StructType([rows.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(bucket: tuple, records: pa.Table, start: pa.Table) -> pa.Table:
        by_key = np.lexsort([records[c].to_numpy() for c in ("size", "crc", "tag")])
        order = by_key[fisher_yates(len(by_key), [seed, bucket[0].as_py()])]
        place = np.arange(len(order)) + start["start"][0].as_py()
        shard = place * shards // n
        slot = place - -(-shard * n // shards)
        return pa.table({"row": records["row"].combine_chunks().take(pa.array(order)), "shard": pa.array(shard, pa.int32()), "slot": slot})

    rows = rows.withColumn("crc", F.coalesce("crc", F.lit(-1)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, MOST_TASKS))
    rows = rows.repartition(tasks, "bucket")
    out = rows.groupBy("bucket").cogroup(starts.groupBy("of")).applyInArrow(shuffled, schema).select("row.*", "shard", "slot")
    path = path or scratch_path(docs.sparkSession, "shards")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
