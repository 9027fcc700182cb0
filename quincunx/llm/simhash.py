"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most four different bits differ in at most four of their
eight bytes, so they share at least four positional bytes.  Postings of single bytes would
hold 1/256 of the corpus each; an index entry is therefore a set of positional bytes at
once, from a family of positions of which any four contain a whole member.  Each pair that
meets in a posting has its shared positional bytes tallied; pairs with the guaranteed
minimum are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import forest, keyed_texts, maybe_in, runs, tiled, written
from quincunx.llm.components import connected

BYTES = 8
TILE = 4096
BLOCK = 256  # rows of a tile compared at once


def shingles(text: str, words: int, seed: int) -> np.ndarray:
    """The XXH64 hashes of a text's word shingles, in order; none of a text without a word."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = min(words, len(tokens)) - 1
    spans = zip(starts[: len(tokens) - last].tolist(), ends[last:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: str, words: int, seed: int) -> int:
    """The 64-bit SimHash of a text's word shingles, each hashed with XXH64."""
    return majority(shingles(text, words, seed))


def fingerprints(docs: DataFrame, *, words: int = 5, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) of every row.  A-Z count as a-z; null texts and texts without a word
    have print 0, and a text with fewer words than a shingle is one shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "print"])

    return keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, print long")


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` (3 or 4) of the eight positions, one of which lies in any four positions.

    For three: cut the positions into groups A, B, C, and take what lies within a group, or
    with two in a group and one in the next (Turan's construction), 20 sets in all.
    """
    if width == 4:
        return list(combinations(range(BYTES), 4))
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(places: tuple[int, ...]) -> bool:
        own = [sum(group[p] == g for p in places) for g in range(3)]
        return max(own) == 3 or any(own[g] == 2 and own[(g + 1) % 3] == 1 for g in range(3))

    return [places for places in combinations(range(BYTES), 3) if chosen(places)]


def postings(prints: DataFrame, width: int) -> DataFrame:
    """(entry, print): each print under all its index entries."""

    def entry(number: int, places: tuple[int, ...]):
        value = F.lit(number).cast("long")
        for p in places:
            value = F.shiftleft(value, 8) + F.shiftright("print", 8 * p).bitwiseAND(F.lit(255))
        return value

    entries = F.array(*[entry(n, places) for n, places in enumerate(position_sets(width))])
    return prints.select(F.explode(entries).alias("entry"), "print")


ONES = np.uint64(0x0101010101010101)


def different_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each word are not zero."""
    x = x | ((x >> np.uint64(4)) & (ONES * np.uint64(0x0F)))
    x = x | ((x >> np.uint64(2)) & (ONES * np.uint64(0x03)))
    x = x | (x >> np.uint64(1))
    return np.bitwise_count(x & ONES).astype(np.int8)


def close_pairs(prints: np.ndarray, chunk: np.ndarray, within: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b), a < b, of prints of a tile with at most ``most`` different bits."""
    left, right = [], []
    for start in range(0, len(prints), BLOCK):
        mine = slice(start, start + BLOCK)
        different = prints[mine, None] ^ prints[None, start:]
        enough = BYTES - different_bytes(different) >= BYTES - most
        a, b = np.nonzero(enough)
        real = (b > a) & (np.bitwise_count(different[a, b]) <= most)
        a, b = a[real] + start, b[real] + start
        if not within:
            cross = chunk[a] != chunk[b]
            a, b = a[cross], b[cross]
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def near_prints(prints: DataFrame, most: int = 4, width: int = 3) -> DataFrame:
    """Links (a, b) among distinct prints that join all within ``most`` <= 4 bits of each other.

    A tile hands on a spanning forest of its pairs, at most one link for each member.
    """
    if not 0 <= most <= 4:
        raise ValueError("the index guarantees pairs of at most 4 bits")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, ["entry", "lo", "hi"]):
            value = table.column("print").to_numpy().view(np.uint64)
            chunk, lo, hi = (table.column(c).to_numpy() for c in ("chunk", "lo", "hi"))
            a_out, b_out = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                a, b = close_pairs(value[s:e], chunk[s:e], lo[s] == hi[s], most)
                if len(a):
                    label = forest(e - s, a, b)
                    moved = np.flatnonzero(label != np.arange(e - s))
                    a_out.append(value[s:e][moved])
                    b_out.append(value[s:e][label[moved]])
            if a_out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (a_out, b_out)], ["a", "b"]
                )

    return tiled(postings(prints, width), "entry", "print", TILE).mapInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, words: int = 5, seed: int = 42, most: int = 4, width: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest doc_id reachable over prints with at most ``most``
    different bits.  Equal prints count as one from the start, so copies cost nothing
    further.  Rows with a null doc_id get a component but never name one.  ``width`` = 4
    makes entries rarer at more index rows, for more than some 10^9 distinct prints; the
    result is the same.
    """
    printed = written(fingerprints(docs, words=words, seed=seed, key=key, text=text), "prints")
    distinct = written(printed.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    found = connected(near_prints(distinct.select("print"), most, width)).withColumnRenamed("node", "print")
    joined = found.join(distinct, "print")
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    moved = joined.join(smallest, "component").select("print", "component_id")
    home = distinct.join(moved, "print", "left").select("print", F.coalesce("component_id", "first").alias("component_id"))
    return printed.join(home, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, *, words: int = 5, seed: int = 42, most: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, with all their columns.

    Rows of one doc_id are one document, of which one row stays.  Rows with a null doc_id
    can't name a component and stay as they are.
    """
    return named(docs, near_duplicates(docs, words=words, seed=seed, most=most, key=key, text=text), key)


def named(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component in ``groups``(doc_id, component_id),
    one of each doc_id; rows with a null one stay.  Only rows that may go are shuffled."""
    marks = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("doc_id") != F.col("component_id")).alias("_gone"), (F.count("*") > 1).alias("_twice")
    )
    marks = written(marks.where("_gone OR _twice").withColumnRenamed("doc_id", "_key"), "marks")
    rows = maybe_in(docs, [F.col(key).cast("long")], marks, [F.col("_key")])
    left = rows.where("_maybe").join(marks, F.col(key) == F.col("_key"), "left").where("_gone IS NULL OR NOT _gone")
    again = left.where("_twice").dropDuplicates([key])
    kept = rows.where("NOT _maybe").select(*docs.columns).unionByName(left.where("_twice IS NULL").select(*docs.columns))
    return kept.unionByName(again.select(*docs.columns))
