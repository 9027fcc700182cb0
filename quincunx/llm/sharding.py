"""A two-pass external shuffle into shards.

First pass: seeded hashes scatter the records uniformly into memory-sized buckets, some
number of them to a shard.  Second pass: each bucket is read whole, put into random order by
a Fisher-Yates shuffle and written.  A shard is its buckets one after the other.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quincunx.llm.common import shared_folder

BUCKET_BYTES = 8 << 20
BROADCAST_ROWS = 100_000  # up to so many buckets, their offsets go to every task
SHUFFLED = "doc_id long, text string, shard int, bucket long, place long"


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash of (key, shard): one more shard takes rows only into itself."""
    scores = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def fisher_yates(n: int, seed: int, shard: int, bucket: int) -> list[int]:
    """A random order of n records, a function of seed, shard and bucket."""
    order = list(range(n))
    rng = np.random.default_rng([seed, shard, bucket])
    picks = rng.integers(0, np.arange(n, 0, -1)) if n else []
    for last, pick in zip(range(n - 1, 0, -1), picks, strict=False):
        order[last], order[pick] = order[pick], order[last]
    return order


def shuffled_shards(
    docs: DataFrame, shards: int, seed: int, folder: str | None = None, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes all rows to ``folder`` as Parquet, one subfolder per shard, and reads them back:
    (doc_id, text, bucket, place, shard, slot), where ``slot`` numbers a shard's rows from 0.

    The shard depends on the key and the number of shards alone.  Records of one key spread
    over the buckets of their shard by their position in the input, so ``docs`` should be a
    stored table, whose rows keep their positions when a task runs again.  Null keys share
    a shard; null texts stay null; repeated rows all stay.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0
    buckets = max(1, -(-total // (shards * BUCKET_BYTES)))
    scattered = rows.withColumns({
        "shard": shard_of(F.col("doc_id"), shards, seed),
        "bucket": F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(buckets)),
    })

    def shuffle(table: pa.Table) -> pa.Table:
        # Rows arrive in any order; sorted by content first, a bucket run again comes out the same.
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, shard, bucket)))
        return table.append_column("place", pa.array(np.arange(table.num_rows)))

    scattered.groupBy("shard", "bucket").applyInArrow(shuffle, SHUFFLED).write.partitionBy("shard").parquet(folder)
    stored = docs.sparkSession.read.schema(SHUFFLED).parquet(folder)
    # One row per bucket.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        stored.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    if shards * buckets <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return stored.join(bases, ["shard", "bucket"]).select(
        "doc_id", "text", "bucket", "place", "shard", (F.col("base") + F.col("place")).alias("slot")
    )
