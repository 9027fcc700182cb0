"""Token counts by byte-pair merging with a heap and linked lists, without identifiers.

The words that a batch of texts adds to the known ones are merged together: their symbols
form one array, linked in both directions inside each word.  A heap holds the ranks of the
adjacent pairs; the lowest rank is popped, all its pairs are merged from left to right, and
the ranks of the new neighbours are pushed.  Within a word this is the order of merging it
alone, since its lowest pair is always merged first.  A word's count is its number of
symbols less its number of merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quincunx.llm.common import collector_paused, held_by_worker, keyed_texts, slices
from quincunx.llm.words import Splitter, byte_symbols

BATCH_BYTES = 8 << 20  # of text worked on at a time in one task
KNOWN_CHUNKS = 600_000  # counts a worker remembers; beyond that it keeps those of the latest batch


class MergeTable:
    """The merges of one vocabulary file, in arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        keys = self.left * self.width + self.right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.final = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        special = [t["content"] for t in content["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1 where the vocabulary doesn't merge it."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (a piece of text that merges never cross)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbol = np.append(self.inner[raw], -1)  # the last one stands for "no neighbour"
        nobody = len(raw)
        symbol[ends[sizes > 0] - 1] = self.final[raw[ends[sizes > 0] - 1]]
        follows = np.arange(1, nobody + 2)
        follows[ends[sizes > 0] - 1] = nobody
        follows[nobody] = nobody
        before = np.arange(-1, nobody)
        before[(ends - sizes)[sizes > 0]] = nobody
        before = np.append(before[:nobody], nobody)
        merges = np.zeros(nobody + 1, bool)  # symbols swallowed by the one before

        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def push(places: np.ndarray) -> None:
            places = places[(places != nobody)]
            places = places[follows[places] != nobody]
            rank = self.ranks(symbol[places], symbol[follows[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            starts = [0, *cuts.tolist(), len(rank)]
            for r, a, b in zip(rank[[0, *cuts]].tolist(), starts, starts[1:], strict=False):
                if not waiting[r]:
                    heapq.heappush(heap, r)
                waiting[r].append(places[a:b])

        push(np.arange(nobody))
        while heap:
            r = heapq.heappop(heap)
            held = waiting.pop(r)
            places = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            second = follows[places]
            # A pair may be gone, since one of its halves has been merged meanwhile.
            real = (symbol[places] == self.left[r]) & (symbol[second] == self.right[r]) & ~merges[places]
            places, second = places[real], second[real]
            if not len(places):
                continue
            if self.left[r] == self.right[r] and len(places) > 1 and np.isin(second, places).any():
                places = _from_the_left(places, second)
                second = follows[places]
            after = follows[second]
            symbol[places] = self.joined[r]
            merges[second] = True
            follows[places] = after
            before[after] = places
            before[nobody] = nobody
            push(np.concatenate([before[places], places]))
        merged = np.append(0, np.cumsum(merges[:nobody]))
        return sizes - (merged[ends] - merged[ends - sizes])


def _from_the_left(places: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of overlapping pairs such as in 'aaa', those that merging from the left takes."""
    taken, gone = [], set()
    for p, q in zip(places.tolist(), second.tolist(), strict=True):
        if p not in gone:
            taken.append(p)
            gone.add(q)
    return np.array(taken)


class TextCounter:
    """Counts texts by chunks between white space, remembering each chunk's count."""

    def __init__(self, path: str):
        self.merges = MergeTable(path)
        self.split = Splitter(Tokenizer.from_file(path))
        self.known: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        split = [self.split.words(c) for c in chunks]
        words = list({w for ws in split for w in ws})
        count = dict(zip(words, self.merges.count(words).tolist(), strict=True))
        self.known.update(zip(chunks, [sum(map(count.__getitem__, ws)) for ws in split], strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            cut = self.merges.special.split(text) if "<" in text else [text]
            extra.append(len(cut) - 1)
            parts.append([c for part in cut for c in self.split.chunks(part)])
        fresh = set().union(*parts)
        if len(self.known) + len(fresh) > KNOWN_CHUNKS:
            self.known = {c: self.known[c] for c in fresh & self.known.keys()}
        self.learn(fresh - self.known.keys())
        return [sum(map(self.known.__getitem__, p)) + e for p, e in zip(parts, extra, strict=True)]


def text_counter(path: str) -> TextCounter:
    """One for each worker process, which keeps what it has learned from task to task."""
    return held_by_worker(f"counter {path}", lambda: TextCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, in one pass without a shuffle.

    Null and empty texts have no tokens; repeated rows and null keys are kept as they come.
    ``path`` is the vocabulary's place on the executors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counter(path)
        for batch in slices(batches, 1, BATCH_BYTES):
            with collector_paused():
                n = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["a", "b", "c"])

    rows = keyed_texts(docs, key, text).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
