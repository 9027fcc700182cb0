"""Byte-pair encoding and decoding of whole texts.

A word's symbols form a doubly linked list.  A priority queue holds the merge ranks of its
adjacent pairs; the lowest is popped, skipped if one of its halves has changed meanwhile, and
merged otherwise, and the ranks of the two new pairs are pushed.  Decoding concatenates the
vocabulary's strings of the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from quincunx.llm.common import collector_paused, held_by_worker, keyed_texts, slices
from quincunx.llm.words import Splitter, byte_symbols

BATCH_BYTES = 4 << 20  # of text worked on at a time in one task
KNOWN_CHUNKS = 500_000  # chunks between white space whose ids a worker remembers
KNOWN_WORDS = 400_000  # and words

ID = np.dtype("<u4")


class Coder:
    """Ids of texts and texts of ids, for one vocabulary file; chunks and words are remembered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab, suffix = content["model"]["vocab"], content["model"].get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
        self.left, self.right = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        self.joined = [vocab[a + b] for a, b in pairs]
        self.width = max(vocab.values()) + 1
        self.rank = {a * self.width + b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.inner = [vocab[c] for c in byte_symbols()]
        self.final = [vocab[c + suffix] for c in byte_symbols()]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.marks = re.compile("(" + ("|".join(map(re.escape, self.special)) or "(?!)") + ")")
        strings = {i: s for s, i in (vocab | self.special).items()}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.split = Splitter(Tokenizer.from_file(path))
        self.known: dict[str, bytes] = {}
        self.ids: dict[bytes, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        n = len(word)
        symbol = [self.inner[b] for b in word]
        symbol[-1] = self.final[word[-1]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, width = self.rank, self.width
        queue = []
        for place in range(n - 1):
            if (r := rank.get(symbol[place] * width + symbol[place + 1])) is not None:
                queue.append(r << 32 | place)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            r, place = entry >> 32, entry & 0xFFFFFFFF
            second = after[place]
            # Stale: a swallowed symbol is -1, and a grown one is no longer the pair's half.
            if second == n or symbol[place] != self.left[r] or symbol[second] != self.right[r]:
                continue
            symbol[place], symbol[second] = self.joined[r], -1
            after[place] = onward = after[second]
            if onward < n:
                before[onward] = place
                if (r := rank.get(symbol[place] * width + symbol[onward])) is not None:
                    heapq.heappush(queue, r << 32 | place)
            if (back := before[place]) >= 0 and (r := rank.get(symbol[back] * width + symbol[place])) is not None:
                heapq.heappush(queue, r << 32 | back)
        return [s for s in symbol if s >= 0]

    def learn(self, chunks: set[str]) -> None:
        split = [self.split.words(c) for c in chunks]
        words = {w for ws in split for w in ws}
        fresh = words - self.ids.keys()
        if len(self.ids) + len(fresh) > KNOWN_WORDS:
            self.ids = {w: self.ids[w] for w in words & self.ids.keys()}
        self.ids.update((w, np.array(self.merged(w), ID).tobytes()) for w in fresh)
        self.known.update(zip(chunks, [b"".join(map(self.ids.__getitem__, ws)) for ws in split], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        parts = []
        for text in texts:
            if "<" not in text or len(cut := self.marks.split(text)) == 1:
                parts.append(self.split.chunks(text))
            else:  # the library takes its special strings out first
                parts.append([c for k, part in enumerate(cut) for c in ([part] if k % 2 else self.split.chunks(part))])
        fresh = set().union(*parts)
        if len(self.known) + len(fresh) > KNOWN_CHUNKS:
            self.known = {c: self.known[c] for c in fresh & self.known.keys()}
        self.known.update((s, np.array([i], ID).tobytes()) for s, i in self.special.items())
        self.learn(fresh - self.known.keys())
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary's strings one after another; a space parts them, as the library has no decoder here."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, ID).tolist()))


def coder(path: str) -> Coder:
    return held_by_worker(f"coder {path}", lambda: Coder(path))


def coded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, in one pass without a shuffle.

    ``ids`` are little-endian 32-bit integers, ``decoded`` UTF-8.  Null and empty texts have
    no ids and decode to nothing; repeated rows and null keys are kept as they come.  A word
    is merged in time n log n, however long; ``path`` is the vocabulary's place on the executors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, 1, BATCH_BYTES):
            with collector_paused():
                ids = own.encode(batch.column(1).to_pylist())
                decoded = [own.decode(i) for i in ids]
            n = pa.array([len(i) // ID.itemsize for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["a", "b", "c", "d"])

    return keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same with digests, which stay in the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in slices(batches, 1, BATCH_BYTES):
            with collector_paused():
                ids = own.encode(batch.column(1).to_pylist())
                decoded = [sha(own.decode(i)) for i in ids]
            n = pa.array([len(i) // ID.itemsize for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([sha(i) for i in ids], pa.string()), pa.array(decoded, pa.string())], ["a", "b", "c", "d"])

    return keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
