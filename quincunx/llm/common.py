"""What several operators share: written tables, plain input columns, bounded batches."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the texts' word rule: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

BITMAP = 1 << 15  # bits that bitmap_construct_agg puts into one value
MOST_BITS = 1 << 27


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a folder of this machine only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quincunx-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a stored table: lineage ends here, and lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash; null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def maybe_in(rows: DataFrame, key: list[Column], wanted: DataFrame, same: list[Column]) -> DataFrame:
    """``rows`` with ``_maybe``: true where ``key`` equals ``same`` of a row of the stored table
    ``wanted``, and for one in 16 of the others or fewer.  A join of what may match then
    shuffles few rows in vain.

    There are 16 to 32 hash values for each wanted row, and those that occur are set in bitmaps,
    which are broadcast: 16 MB at most.  Beyond 2^23 wanted rows more of the others pass.
    """
    values = min(max(1 << (16 * wanted.count()).bit_length(), BITMAP), MOST_BITS)
    mine, theirs = (F.pmod(F.xxhash64(*columns), F.lit(values)) for columns in (key, same))
    bits = wanted.select(theirs.alias("_at")).select(F.shiftright("_at", 15).alias("_cell"), (F.col("_at") % BITMAP).alias("_bit"))
    bits = bits.repartition("_cell").groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumn("_at", mine).join(F.broadcast(bits), F.shiftright("_at", 15) == F.col("_cell"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_at % {BITMAP} div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(_at % 8 AS int)")
    return found.withColumn("_maybe", F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))).drop("_at", "_cell", "_bits")


def n_bytes(text: str | Column) -> Column:
    return F.octet_length(text).cast("long")


def held_by_worker(name: str, make: Callable):
    """The object ``name`` of this worker process, made at its first use and kept from task to task.

    Functions travel by value, so executors need no copy of this package; what a task leaves
    in a module of its own would go with it, hence a place that every task finds again.
    """
    place = sys.modules.setdefault("_quincunx_held", types.ModuleType("_quincunx_held")).__dict__
    if name not in place:
        place[name] = make()
    return place[name]


@contextlib.contextmanager
def collector_paused():
    """For work that makes millions of small lists without cycles, which Python's collector of
    cycles would go through again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has at most about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + (size or 0) > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def tiled(rows: DataFrame, key: str, node: str, limit: int) -> DataFrame:
    """Candidate groups cut into tiles, so that no task meets a whole hot group: ``chunked`` rows, ``dealt``."""
    return dealt(chunked(rows, key, node, limit), key)


def chunked(rows: DataFrame, key: str, node: str, limit: int, size: str = "1L") -> DataFrame:
    """``rows`` with their ``chunk`` of as many as ``tiles`` tells.

    Rows of ``key`` groups with one member go.  A group of n rows, or of n bytes where the SQL
    ``size`` tells a row's bytes, becomes ceil(n / limit) chunks by a hash of ``node``.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.expr(size)).alias("_size")).where("_n > 1")
    sizes = sizes.select(key, F.ceil(F.greatest("_size", F.lit(1)) / limit).cast("int").alias("tiles"))
    return rows.join(sizes, key).withColumn("chunk", F.pmod(F.xxhash64(node), F.col("tiles")).cast("int"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``chunked`` rows once for each tile they are in.

    Each pair of chunks is a tile of its own: every two rows of a group meet in exactly one
    tile.  Tiles come back partitioned and sorted by (key, lo, hi); ``chunk`` tells the two
    sides of a tile with lo < hi.
    """
    return (
        rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"lo": F.least("chunk", "_other"), "hi": F.greatest("chunk", "_other")})
        .drop("tiles", "_other")
        .repartition(key, "lo", "hi")
        .sortWithinPartitions(key, "lo", "hi")
    )


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal keys out of sorted batches: a table, and where its runs begin and end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_starts(table, keys), table.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each of ``size`` positions reaches over the links a[k] - b[k]."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
