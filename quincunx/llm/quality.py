"""Quality rules: fixed rules over a document's statistics, then boosted trees over the same."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import keyed_texts, slices
from quincunx.llm.trees import Forest, fit

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?.,;:"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Feature: direction in which it may move the score of being good (0: either).
FEATURES = {
    "words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "marks_per_word": 0, "distinct_share": 0, "words_per_line": 0,
}
TRAINING_ROWS = 8_000
BATCH_BYTES = 4 << 20  # of text worked on at a time in one task


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The five counts of a text, and its features in the order of FEATURES."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = _among(raw, SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    each = max(n, 1)
    features = [
        np.log1p(n), chars / each, symbols / each, duplicates / max(len(lines), 1), repeats / each,
        _among(raw, UPPER) / max(chars, 1), _among(raw, DIGITS) / max(chars, 1), _among(raw, MARKS) / each,
        len(set(words)) / each, np.log1p(n / max(len(lines), 1)),
    ]
    return (n, chars, symbols, duplicates, repeats), features


def _among(raw: bytes, wanted: bytes) -> int:
    return len(raw) - len(raw.translate(None, wanted))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, by 64-bit hashes of words and windows."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(count, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (own[k : k + count] ^ (own[k : k + count] >> np.uint64(29)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(count, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:count] += twice
    covered[window:] -= twice
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def training_rows(docs: DataFrame, labels: DataFrame, most: int, seed: int, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents, those with the smallest hashes.

    Documents that the fixed rules reject don't need the trees and don't train them.
    """
    chosen = (
        labels.select(F.col(key).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality").limit(most)
    )
    # At most ``most`` pairs of numbers.
    rows = keyed_texts(docs, key, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, BATCH_BYTES):
            found = [statistics(t.as_py()) for t in batch.column(2)]
            keep = [not base_failed(c[0], c[4]) for c, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for _, f in found], pa.list_(pa.float64())), pa.array(keep)],
                ["doc_id", "y", "x", "used"],
            )

    got = rows.mapInArrow(run, "doc_id long, y int, x array<double>, used boolean").where("used")
    # One row for each document and label, however often its doc_id repeats.
    got = got.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    got = sorted((r.x, r.y) for r in got)  # the same model whatever the order of rows
    x = np.array([r[0] for r in got], float).reshape(len(got), len(FEATURES))
    return x, np.array([r[1] for r in got], float)


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, most: int = TRAINING_ROWS, seed: int = 7, key: str = "doc_id", text: str = "text"
) -> Forest:
    """Boosted trees for the chance that a document is good; without labels they keep everything."""
    x, y = training_rows(docs, labels, most, seed, key, text)
    return fit(x, y, tuple(FEATURES.values()))


def judged(docs: DataFrame, model: Forest, *, threshold: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts..., base_failed, score, kept) of every row, in one pass without a shuffle.

    A row is kept if the fixed rules pass it and its log-odds of being good reach
    ``threshold``.  Null and empty texts have no words, so the rules reject them; repeated
    rows and null keys are judged like any others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_BYTES):
            found = [statistics(t.as_py()) for t in batch.column(1)]
            score = model.score(np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))
            failed = np.array([base_failed(c[0], c[4]) for c, _ in found], bool)
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return keyed_texts(docs, key, text).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Forest, *, threshold: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass."""
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place, BATCH_BYTES):
            found = [statistics(t.as_py() or "") for t in batch.column(place)]
            score = model.score(np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))
            failed = np.array([base_failed(c[0], c[4]) for c, _ in found], bool)
            yield batch.filter(pa.array(~failed & (score >= threshold)))

    return docs.mapInArrow(run, docs.schema)
