"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document's tokens are cut into whole sequences and a shorter tail.  Tails are dealt into
memory-sized buckets by a hash, and each bucket is packed alone: the cost of a tail is
linear in its length plus quadratic for attention, and tails go in descending order to the
cheapest sequence with room for them.  What fits nowhere whole is cut into the gaps, so a
bucket leaves less than one sequence unfilled.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quincunx.llm.common import collector_paused, held_by_worker, keyed_texts, slices
from quincunx.llm.words import ODD_CONTROLS, Splitter, byte_symbols, latin

BATCH_BYTES = 4 << 20  # of text tokenised at a time in one task
BUCKET_BYTES = 4 << 20  # of text whose tails are packed together
WORDS_AT_ONCE = 512  # the library's own records of a word are far larger than its ids
KNOWN_CHUNKS = 700_000  # chunks whose ids a worker remembers
KNOWN_WORDS = 400_000  # and words: new chunks are often known words in another case, or with a comma

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_cost double"
)
ID = np.dtype("<u4")


class TextEncoder:
    """Ids of whole texts, as the library gives them; chunks between white space are remembered.

    The vocabulary's split pattern never crosses white space, so a text's ids are those of
    its chunks.  Texts with the vocabulary's special strings, or with control characters on
    whose being white space the library and Python differ, go to the library whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.split = Splitter(self.whole)
        self.words = Tokenizer(self.whole.model)  # the same merges for words split here
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")  # no byte's symbol is a space
        vocabulary, suffix = self.whole.get_vocab(with_added_tokens=False), self.whole.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for s, i in vocabulary.items() if suffix and s.endswith(suffix)]] = True
        self.store = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else ID
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, bytes] = {}
        self.ids: dict[bytes, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        split = [self.split.words(c) for c in chunks]
        words = {w for ws in split for w in ws}
        fresh = words - self.ids.keys()
        if len(self.ids) + len(fresh) > KNOWN_WORDS:
            self.ids = {w: self.ids[w] for w in words & self.ids.keys()}
        fresh = list(fresh)
        for k in range(0, len(fresh), WORDS_AT_ONCE):
            some = fresh[k : k + WORDS_AT_ONCE]
            self.ids.update(zip(some, self.merged([w.decode("latin-1").translate(self.symbols) for w in some]), strict=True))
        self.known.update(zip(chunks, [b"".join(map(self.ids.__getitem__, ws)) for ws in split], strict=True))

    def merged(self, spelled: list[str]) -> list[bytes]:
        """The ids of each word.  The library merges them in one call, which takes half the time,
        and ids with the vocabulary's suffix tell where a word ends.
        """
        ids = np.array(self.words.encode(" ".join(spelled), add_special_tokens=False).ids, self.store)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(spelled):
            raw, cuts = ids.tobytes(), [0, *(ends * self.store.itemsize).tolist()]
            return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        # No suffix, or one that a text spells out: each word alone.
        found = self.words.encode_batch_fast(spelled, add_special_tokens=False)
        return [np.array(e.ids, self.store).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool("<" in t and self.special.search(t) or any(map(t.__contains__, ODD_CONTROLS))) for t in texts]
        parts = [None if o else (t.lower() if latin(t) else t).split() for t, o in zip(texts, odd, strict=True)]
        fresh = set().union(*filter(None, parts))
        if len(self.known) + len(fresh) > KNOWN_CHUNKS:
            self.known = {c: self.known[c] for c in fresh & self.known.keys()}
        self.learn(fresh - self.known.keys())
        return [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, self.store).tobytes()
            if p is None
            else b"".join(map(self.known.__getitem__, p))
            for t, p in zip(texts, parts, strict=True)
        ]


def text_encoder(path: str) -> TextEncoder:
    return held_by_worker(f"encoder {path}", lambda: TextEncoder(path))


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype(ID).tobytes())


def encoded(docs: DataFrame, path: str, end_id: int, length: int) -> DataFrame:
    """(doc_id, doc_tokens, full, tail, wide): checksums of the whole sequences, ids of the tail."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for batch in slices(batches, 1, BATCH_BYTES):
            sizes, full, tails = [], [], []
            with collector_paused():
                encoded_texts = encoder.encode(batch.column(1).to_pylist())
            for raw in encoded_texts:
                ids = np.append(np.frombuffer(raw, encoder.store), encoder.store.type(end_id))
                whole = len(ids) // length * length
                sizes.append(len(ids))
                full.append([_checksum(ids[a : a + length]) for a in range(0, whole, length)])
                tails.append(ids[whole:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array([encoder.store.itemsize] * len(sizes), pa.int32())],
                ["doc_id", "doc_tokens", "full", "tail", "wide"],
            )

    return docs.mapInArrow(run, "doc_id long, doc_tokens long, full array<long>, tail binary, wide int")


def balance(sizes: list[int], length: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Packs tails of the given sizes: (tail, start, length, sequence, offset) and each sequence's cost.

    ``ready`` holds the sequences with room for the tail in hand, cheapest first; the others
    wait by their room, and come back once tails are short enough.
    """
    count = -(-sum(sizes) // length)
    room, cost = [length] * count, [0.0] * count
    ready, waiting, placed, rest = [(0.0, s) for s in range(count)], [], [], []

    def put(tail: int, start: int, n: int, s: int) -> None:
        placed.append((tail, start, n, s, length - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for tail in sorted(range(len(sizes)), key=lambda t: (-sizes[t], t)):
        n = sizes[tail]
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (cost[s], s))
        if not n:
            continue
        if not ready:
            rest.append(tail)
            continue
        s = heapq.heappop(ready)[1]
        put(tail, 0, n, s)
        if room[s] >= n:
            heapq.heappush(ready, (cost[s], s))
        elif room[s]:
            heapq.heappush(waiting, (-room[s], s))
    gaps = [(cost[s], s) for s in range(count) if room[s]]
    heapq.heapify(gaps)
    for tail in rest:
        start = 0
        while start < sizes[tail]:
            s = gaps[0][1]
            n = min(room[s], sizes[tail] - start)
            put(tail, start, n, s)
            start += n
            if room[s]:
                heapq.heapreplace(gaps, (cost[s], s))
            else:
                heapq.heappop(gaps)
    return placed, cost


def pack(
    docs: DataFrame, path: str, *, end_id: int, length: int = 4096, linear: float = 1.0, quadratic: float = 1.0 / 4096,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence.

    Each token of each row of ``docs`` is in exactly one piece; null and empty texts have the
    end token alone.  Rows with equal or null keys are packed like any others.  The only
    shuffle moves tails, which are shorter than ``length``; sequence numbers are unique, and
    a bucket's numbers lie ``buckets`` apart.
    """
    rows = keyed_texts(docs, key, text)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def fill(table: pa.Table) -> pa.Table:
        bucket, wide = table.column("bucket")[0].as_py(), table.column("wide")[0].as_py()
        store = np.dtype("<u2") if wide == 2 else ID
        keys, tokens = table.column("doc_id").combine_chunks(), table.column("doc_tokens").to_pylist()
        tails = [np.frombuffer(t, store) for t in table.column("tail").to_pylist()]
        placed, cost = balance([len(t) for t in tails], length, linear, quadratic)
        out = [
            (r, tokens[r] - len(tails[r]) + a, n, _checksum(tails[r][a : a + n]), s, at, cost[s])
            for r, a, n, s, at in placed
        ]
        number, own = len(cost), linear * length + quadratic * length * length
        for r, sums in enumerate(table.column("full").to_pylist()):
            for k, checksum in enumerate(sums):
                out.append((r, k * length, length, checksum, number, 0, own))
                number += 1
        r, start, n, checksum, s, at, price = zip(*out, strict=True) if out else [()] * 7
        return pa.table({
            "doc_id": keys.take(pa.array(r, pa.int64())),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(n, pa.int64()),
            "ids_crc32": pa.array(checksum, pa.int64()),
            "doc_tokens": pa.array([tokens[x] for x in r], pa.int64()),
            "sequence_id": pa.array([x * buckets + bucket for x in s], pa.int64()),
            "offset": pa.array(at, pa.int64()),
            "sequence_cost": pa.array(price, pa.float64()),
        })

    tails = encoded(rows, path, end_id, length)
    # The bucket must not depend on the order of rows, or a repeated task would deal anew.
    dealt = tails.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tail"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(fill, PIECES)
