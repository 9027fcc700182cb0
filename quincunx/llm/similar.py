"""Near copies by SimHash prints and minhash bytes, decided by the exact Jaccard similarity.

Candidates come from two inverted indexes of positional bytes with count filtering.  The
first is that of ``simhash``: 64-bit SimHash prints of the same shingles, at most four bits
apart.  At a similarity of 0.8 few pairs are so close, so a second index finds the rest: its
print has 96 positional bytes, each from the shingle that is smallest under a hash of its
own, so two texts of similarity s agree at each byte with chance s at least.  An index entry
is four neighbouring bytes: of 24 entries a pair at 0.8 shares one in all but 3 of 10^6
cases, since 1 - (1 - 0.8^4)^24, and 56 bytes or more (77 on average) make it a candidate.

Candidates only tell which texts must be compared: a tile hands on a spanning forest of its
pairs, never all, and every two texts that candidates join, however far, are then compared
by their whole sets of shingles, again tile by tile.  Only that decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import chunked, dealt, forest, keyed_texts, maybe_in, runs, slices, tiled, written
from quincunx.llm.components import connected
from quincunx.llm.simhash import majority, named, near_prints, shingles

BYTES = 96
ENTRY = 4  # bytes of an index entry
SHARED = 56  # bytes that candidates share at least
TILE = 2048
BLOCK = 256  # rows of a tile compared at once
SHARE = 0.8
BATCH_BYTES = 4 << 20  # of text worked on at a time in one task, and of sets in a chunk


def print_of(hashes: np.ndarray) -> np.ndarray:
    """The positional bytes of distinct shingle hashes; zeros where there are none."""
    rng = np.random.default_rng(BYTES)
    mask = rng.integers(0, 1 << 63, (BYTES, 1), dtype=np.uint64)
    factor = rng.integers(0, 1 << 63, (BYTES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BYTES, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        mixed = (hashes[None, k : k + 4096] ^ mask) * factor
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1), out=least)
    return (least & np.uint64(0xFF)).astype(np.uint8) if len(hashes) else np.zeros(BYTES, np.uint8)


def node_of(own: np.ndarray, seed: int) -> int:
    """A 64-bit hash of distinct shingle hashes in order: the node of their set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed)).view(np.int64))


def sketched(docs: DataFrame, *, words: int, seed: int, key: str, text: str) -> DataFrame:
    """(doc_id, at, node, bytes, simhash, print) of every row; ``at`` is a hash of the text,
    ``bytes`` the length of its set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, BATCH_BYTES):
            nodes, sizes, bits, prints = [], [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py(), words, seed)
                own = np.unique(found)
                nodes.append(node_of(own, seed))
                sizes.append(own.nbytes)
                bits.append(majority(found))
                prints.append(print_of(own))
            flat = np.concatenate(prints).view("<i4") if prints else np.zeros(0, "<i4")
            offsets = np.arange(len(nodes) + 1, dtype=np.int32) * (BYTES // ENTRY)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (nodes, sizes, bits)), column],
                ["doc_id", "at", "node", "bytes", "simhash", "print"],
            )

    rows = keyed_texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("at"), "text")
    return rows.mapInArrow(run, "doc_id long, at long, node long, bytes long, simhash long, print array<int>")


def sets_of(docs: DataFrame, wanted: DataFrame, *, words: int, seed: int, key: str, text: str) -> DataFrame:
    """(component, tiles, chunk, node, shingles) of the texts with a hash and a doc_id in ``wanted``
    (component, tiles, chunk, at, doc_id), a stored table, one row for each node.  Only texts that
    may be wanted are shuffled.  A text repeated under one doc_id comes once for each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 3, BATCH_BYTES):
            new, nodes, sets = [], [], []
            for row, value in enumerate(batch.column(3)):
                own = np.unique(shingles(value.as_py(), words, seed))
                node = node_of(own, seed)
                if node not in seen:
                    seen.add(node)
                    new.append(row)
                    nodes.append(node)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1, 2]).take(pa.array(new, pa.int64())).columns, pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                ["component", "tiles", "chunk", "node", "shingles"],
            )

    texts = keyed_texts(docs, key, text).select("doc_id", F.xxhash64("text").alias("at"), "text")
    place = [F.col("at"), F.col("doc_id")]
    texts, wanted = maybe_in(texts, place, wanted, place).where("_maybe").alias("t"), wanted.alias("w")
    same = (F.col("t.at") == F.col("w.at")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = texts.join(wanted, same).select("component", "tiles", "chunk", "text")
    return texts.mapInArrow(run, "component long, tiles int, chunk int, node long, shingles binary")


def joined_by_prints(entries: DataFrame) -> DataFrame:
    """Links (a, b) of ``entries``(entry, node, print) that join all nodes that meet and share
    ``SHARED`` bytes: a spanning forest of each tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["entry", "lo", "hi"]):
            node = table.column("node").to_numpy()
            flat = table.column("print").combine_chunks().flatten().to_numpy().astype("<i4", copy=False)
            prints = np.ascontiguousarray(flat).view(np.uint8).reshape(-1, BYTES)
            left, right = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                columns = np.ascontiguousarray(prints[s:e].T)
                label = np.arange(e - s)
                for k in range(1, e - s, BLOCK):
                    stop = min(k + BLOCK, e - s)
                    shared = np.zeros((stop - k, stop), np.uint8)
                    for column in columns:
                        shared += column[k:stop, None] == column[None, :stop]
                    a, b = np.nonzero(shared >= SHARED)
                    a, b = label[a + k], label[b]
                    if (a != b).any():
                        label = forest(e - s, a[a != b], b[a != b])[label]
                moved = np.flatnonzero(label != np.arange(e - s))
                if len(moved):
                    left.append(node[s:e][moved])
                    right.append(node[s:e][label[moved]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["a", "b"])

    return tiled(entries, "entry", "node", TILE).mapInArrow(run, "a long, b long")


def joined_by_simhash(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all nodes of ``distinct``(node, simhash) whose SimHash prints
    have at most four different bits."""
    prints = written(distinct.groupBy("simhash").agg(F.min("node").alias("home")), "prints")
    near = near_prints(prints.select(F.col("simhash").alias("print")))
    near = near.join(prints.select(F.col("simhash").alias("a"), F.col("home").alias("x")), "a")
    near = near.join(prints.select(F.col("simhash").alias("b"), F.col("home").alias("y")), "b")
    equal = distinct.join(prints, "simhash").where("node <> home").select("node", "home")
    return near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(equal.toDF("a", "b"))


def linked_sets(sets: list[np.ndarray], side: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Positions (a, b) that join all sets with a Jaccard similarity of ``share`` or more: every
    two sets, or every two on different sides where there are two.

    One set is marked at a time and its marks counted in all others of a size that can fit.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]  # no other set is like the empty one
    if len(order) < 2:
        return []
    two = bool((side != side[0]).any())
    mine, others = (order[side[order] == side.min()], order[side[order] != side.min()]) if two else (order, order)
    if not len(mine) or not len(others):
        return []
    ids = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)[1]
    ids = dict(zip(order.tolist(), np.split(ids, np.cumsum(sizes[order])[:-1]), strict=True))
    flat, long = np.concatenate([ids[k] for k in others.tolist()]), sizes[others]
    starts = np.append(0, np.cumsum(long))
    mark = np.zeros(1 + max(int(x.max()) for x in ids.values()), np.uint8)
    label, links = np.arange(len(sets)), []
    for at, a in enumerate(mine.tolist()):
        size = int(sizes[a])
        low = np.searchsorted(long, share * size - 1) if two else at + 1
        high = np.searchsorted(long, size / share + 1, side="right")
        if low >= high:
            continue
        mark[ids[a]] = 1
        both = np.add.reduceat(mark[flat[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        mark[ids[a]] = 0
        like = others[low:high][both >= share * (size + long[low:high] - both)]
        found, first = np.unique(label[like], return_index=True)
        new = found != label[a]
        if new.any():
            links += [(a, b) for b in like[first[new]].tolist()]
            label[np.isin(label, np.append(found, label[a]))] = a
    return links


def verified(members: DataFrame, share: float) -> DataFrame:
    """Links (a, b) that join all of ``members``(component, tiles, chunk, node, shingles) of one
    component whose sets have a Jaccard similarity of ``share`` or more: a spanning forest of
    each tile.  A node counts once in a tile; the tiles' own shuffle serves for that."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["component", "lo", "hi"]):
            node, chunk = (table.column(c).to_numpy() for c in ("node", "chunk"))
            column = table.column("shingles")
            links = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [np.frombuffer(v.as_buffer(), "<u8") for v in column.slice(s, e - s)]
                links += [(s + a, s + b) for a, b in linked_sets(sets, chunk[s:e], share)]
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    tile = ["component", "lo", "hi"]
    tiles = dealt(members, "component").dropDuplicates([*tile, "node"]).sortWithinPartitions(*tile)
    return tiles.mapInArrow(run, "a long, b long")


def similar_groups(
    docs: DataFrame, *, words: int = 5, share: float = SHARE, seed: int = 42, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable over texts whose sets of word shingles
    have a Jaccard similarity of ``share`` >= 0.8 or more.  A-Z count as a-z; a text with
    fewer words than a shingle is one shingle; null texts and texts without a word are copies
    of each other.  Rows with a null doc_id get a component but never name one.

    Equal sets count as one from the start.  What a group hands from step to step grows with
    its members, not with its pairs; all its pairs are compared, in tiles of bounded size.
    """
    if share < SHARE:
        raise ValueError("the index is laid out for similarities of 0.8 and more")
    rows = written(sketched(docs, words=words, seed=seed, key=key, text=text), "sketches")
    distinct = rows.groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("at", "doc_id")).alias("text"), *(F.min(c).alias(c) for c in ("bytes", "simhash", "print"))
    )
    distinct = written(distinct, "distinct")
    places = distinct.select("node", F.posexplode("print").alias("place", "value"))
    places = places.select(F.expr("shiftleft(cast(place AS long), 32) + value").alias("entry"), "node")
    shared = places.groupBy("entry").count().where("count > 1").select("entry")
    met = places.join(shared, "entry").join(distinct.select("node", "print"), "node")
    near = joined_by_prints(written(met, "entries")).unionByName(joined_by_simhash(distinct.select("node", "simhash")))
    apart = written(connected(near).join(distinct.select("node", "text", "bytes"), "node"), "apart")
    apart = chunked(apart, "component", "node", BATCH_BYTES, "bytes")
    wanted = written(apart.select("component", "tiles", "chunk", "text.*"), "wanted")
    parts = connected(verified(sets_of(docs, wanted, words=words, seed=seed, key=key, text=text), share))
    joined = parts.withColumnRenamed("component", "part").join(distinct.select("node", "first"), "node")
    smallest = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    moved = joined.join(smallest, "part").select("node", "component_id")
    home = distinct.join(moved, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(home, "node").select("doc_id", "component_id")


def first_of_similar(
    docs: DataFrame, *, words: int = 5, share: float = SHARE, seed: int = 42, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group of near copies, with all their columns.

    Rows of one doc_id are one document, of which one row stays.  Rows with a null doc_id
    can't name a group and stay as they are.
    """
    return named(docs, similar_groups(docs, words=words, share=share, seed=seed, key=key, text=text), key)
