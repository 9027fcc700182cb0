"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines.

Two vectors at angle t agree in a sign with probability 1 - t / pi.  The number of tables
follows from the bits of a table and the wanted recall of a pair right at the threshold;
pairs above it are found more often.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import forest, runs, tiled, written
from quincunx.llm.components import connected

TILE = 2048
BLOCK = 512  # rows of a tile compared at once
BUCKET_ROWS = 16  # vectors to a bucket, were all of them at random


def tables_for(bits: int, threshold: float, recall: float) -> int:
    """Tables with which a pair at the threshold meets in one of them with the wanted probability."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def packed(values: np.ndarray) -> bytes:
    """Single floats where they hold every component, else doubles and one byte more."""
    with np.errstate(over="ignore"):
        single = values.astype("<f4")
    return single.tobytes() if (single == values).all() else values.astype("<f8").tobytes() + b"\0"


def unpacked(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of doubles) for each number of components among ``raw``."""
    length = np.array([len(r) for r in raw])
    doubles = length % 4 == 1
    size = np.where(doubles, length // 8, length // 4)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        x = np.empty((len(own), n))
        for wide, kind in ((False, "<f4"), (True, "<f8")):
            of_kind = np.flatnonzero(doubles[own] == wide)
            if len(of_kind):
                joined = b"".join(raw[k][: n * 8] if wide else raw[k] for k in own[of_kind].tolist())
                x[of_kind] = np.frombuffer(joined, kind).reshape(-1, n)
        yield own, x


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, raw): the components as bytes; null where a vector can't link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column(1):
                values = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
                usable = values is not None and len(values) and np.isfinite(values).all() and values.any()
                raw.append(packed(values) if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, raw binary")


class Hyperplanes:
    """Signs of vectors against seeded random hyperplanes, in ``tables`` numbers of ``bits`` bits.

    Vectors scaled to 20 bits and planes of at most 15 are whole numbers whose products add up
    exactly in doubles (up to 2^18 components), so a vector has the same signs whichever batch it is in.
    """

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.planes: dict[int, np.ndarray] = {}

    def signs(self, x: np.ndarray, tables: int) -> np.ndarray:
        """(rows, tables) numbers, of the first ``tables`` ones."""
        size = x.shape[1]
        if size not in self.planes:
            drawn = np.random.default_rng([self.seed, size]).standard_normal((size, self.tables * self.bits))
            self.planes[size] = np.clip(np.rint(drawn * 2**12), -(2**15), 2**15)
        whole = np.rint(x / np.abs(x).max(axis=1)[:, None] * 2**20)
        up = (whole @ self.planes[size][:, : tables * self.bits] > 0).reshape(len(x), tables, self.bits)
        return up @ (1 << np.arange(self.bits))


def signed(groups: DataFrame, planes: Hyperplanes) -> DataFrame:
    """Adds ``signs``, one number for each table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.zeros((batch.num_rows, planes.tables), np.int64)
            for own, x in unpacked(batch.column(2).to_pylist()):
                signs[own] = planes.signs(x, planes.tables)
            ends = np.arange(0, signs.size + 1, planes.tables, dtype=np.int32)
            column = pa.ListArray.from_arrays(ends, pa.array(signs.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], ["node", "copies", "raw", "signs"])

    return groups.mapInArrow(run, "node long, copies long, raw binary, signs array<long>")


def _verify(threshold: float, planes: Hyperplanes):
    """Tiles of a bucket to (a, b, links): links found here first, and a spanning forest of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["bucket", "lo", "hi"]):
            node, copies, bucket, chunk, lo, hi = (
                table.column(c).to_numpy() for c in ("node", "copies", "bucket", "chunk", "lo", "hi")
            )
            raw = table.column("raw").to_pylist()
            a_out, b_out, n_out = [], [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                # Vectors of different lengths have nothing to compare.
                for own, x in unpacked(raw[s:e]):
                    if len(own) < 2:
                        continue
                    own = own + s
                    sides = chunk[own] if lo[s] != hi[s] else None
                    links, label = _linked(x, copies[own], sides, threshold, planes, int(bucket[s] >> 32))
                    met = np.flatnonzero(links)
                    if len(met):
                        a_out.append(node[own[met]])
                        b_out.append(node[own[label[met]]])
                        n_out.append(links[met].astype(np.int64))
            if a_out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (a_out, b_out, n_out)], ["a", "b", "links"]
                )

    return run


def _linked(
    x: np.ndarray, copies: np.ndarray, sides: np.ndarray | None, threshold: float, planes: Hyperplanes, number: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that table ``number`` is the first to find, and the smallest row each reaches by them.

    With ``sides``, only pairs of different sides count.  Pairs live for one block of rows; a
    forest of them goes on.
    """
    unit = x / np.abs(x).max(axis=1)[:, None]  # so that no square overflows
    unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
    links, trees, signs = np.zeros(len(x)), [], None
    for start in range(0, len(x), BLOCK):
        a, b = np.nonzero(unit[start : start + BLOCK] @ unit[start:].T >= threshold)
        new = b > a
        a, b = a[new] + start, b[new] + start
        if sides is not None:
            new = sides[a] != sides[b]
            a, b = a[new], b[new]
        if len(a) and number:
            signs = planes.signs(x, number) if signs is None else signs
            for t in range(number):
                new = signs[a, t] != signs[b, t]
                a, b = a[new], b[new]
        if len(a):
            links += np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
            met = np.union1d(a, b)
            trees.append((met, forest(len(x), a, b)[met]))
    if not trees:
        return links, np.arange(len(x))
    return links, forest(len(x), *map(np.concatenate, zip(*trees, strict=True)))


def near_vectors(
    df: DataFrame, *, threshold: float = 0.9, recall: float = 0.98, bits: int | None = None, seed: int = 17,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are compared as one and counted by their copies; vectors of different
    lengths never link.  Rows with a null id, and vectors that are null, empty, zero or not
    finite throughout, link with nothing.  Rows that share an id share their links.  By
    default buckets would hold 16 random vectors; fewer bits take more comparisons and
    fewer tables for the same recall.
    """
    rows = written(usable_vectors(df, key, vector), "vectors")
    usable = rows.where("raw IS NOT NULL AND vec_id IS NOT NULL")
    groups = usable.groupBy("raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    groups = written(groups.select("node", "copies", "raw"), "groups")
    if bits is None:
        bits = min(31, max(8, round(math.log2(max(1, groups.count()) / BUCKET_ROWS))))
    if not 1 <= bits <= 31:
        raise ValueError("a table takes 1 to 31 bits")
    planes = Hyperplanes(bits, tables_for(bits, threshold, recall), seed)
    stored = written(signed(groups, planes), "signed")
    buckets = stored.select("node", "copies", "raw", F.posexplode("signs").alias("t", "s"))
    buckets = buckets.select(F.expr("shiftleft(cast(t AS bigint), 32) | s").alias("bucket"), "node", "copies", "raw")
    found = written(tiled(buckets, "bucket", "node", TILE).mapInArrow(_verify(threshold, planes), "a long, b long, links long"), "found")

    counted = groups.select("node", (F.col("copies") - 1).alias("links"))
    counted = counted.unionByName(found.select(F.col("a").alias("node"), "links")).groupBy("node").agg(F.sum("links").alias("links"))
    part = connected(found.select("a", "b"))
    by_node = counted.join(part, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))
    by_raw = groups.select("raw", "node").join(by_node, "node").select("raw", "links", "component")
    placed = usable.join(by_raw, "raw").select("vec_id", "links", "component")
    alone = rows.where("raw IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return placed.unionByName(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )
