"""How two tokenizers' tokens lie on each other, corpus-wide.

Texts are cut at single spaces between visible characters, where neither tokenizer joins
anything, so each cut piece has its tokens whatever stands around it; a worker aligns a piece
once.  Byte offsets at which both tokenizers end a token cut the tokens into groups.

In how many documents a pair of ids lies linked is counted two ways.  An A token on the B
token with the same bytes, as in every exact one-to-one group, needs no pair: such documents
are counted in one vector a task, as long as the vocabulary.  Only what irregular groups link
besides goes through a shuffle of pairs, and as one row for each pair of a block of texts,
which also gets its pairs' corpus counts back as one row each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quincunx.llm.common import collector_paused, held_by_worker, keyed_texts, slices, written
from quincunx.llm.words import byte_symbols

BLOCK_BYTES = 4 << 20  # of text in a block
PIECES_AT_ONCE = 4_096  # the libraries' own records of a piece are far larger than its ids
KNOWN_PIECES = 300_000  # pieces whose alignment a worker remembers
A_SHIFT = 32  # a pair is its A id, then 32 bits of its B id

# A single space between characters that are white space in no version of Unicode.
ODD_SPACES = "".join(map(chr, (0x180E, 0x200B, 0xFEFF)))
CUT = re.compile(rf"(?<=[^\s{ODD_SPACES}]) (?=[^\s{ODD_SPACES}])")

DOCUMENT, PIECES, VECTOR = range(3)
STORED = (
    "block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "payload binary, ends binary, ids array<long>, docs array<long>"
)
FIELDS = ("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "payload", "ends", "ids", "docs")
TYPES = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; runs have the given lengths and may be empty."""
    ends = np.cumsum(lengths)
    running = np.append(0, np.cumsum(values))
    return running[ends] - running[ends - lengths]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of all runs, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Aligner:
    """Tokens of both tokenizers on each other, for pieces of text; pieces are remembered.

    A known piece is (groups, links, A tokens, B tokens, number of groups): the groups as text,
    the linked pairs as 64-bit integers.  It is None where a tokenizer changes the text.
    """

    def __init__(self, byte_path: str, piece_path: str):
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        value = {c: b for b, c in enumerate(byte_symbols())}
        with open(byte_path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        self.a_bytes = {i: bytes(map(value.__getitem__, s)) for s, i in vocab.items() if all(c in value for c in s)}
        b_ids = range(self.b.get_piece_size())
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in b_ids
        ]
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64)
        self.spelled = [f"{i}{mark}" for i in range(max(len(self.a_size), len(self.b_size))) for mark in ",|;"]
        # A's ids to B's ids with the same bytes; of two, the one that isn't a stand-in for a byte.
        by_bytes = {self.b_bytes[i]: i for i in sorted(b_ids, key=self.b.is_byte, reverse=True)}
        self.size = max(self.a_bytes) + 1
        self.same = np.full(self.size, -1, np.int64)
        for i, raw in self.a_bytes.items():
            self.same[i] = by_bytes.get(raw, -1)
        self.known: dict[str, tuple | None] = {}

    def learn(self, fresh: list[str]) -> None:
        for k in range(0, len(fresh), PIECES_AT_ONCE):
            some = fresh[k : k + PIECES_AT_ONCE]
            a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in some], add_special_tokens=False)]
            b = self.b.encode(some, num_threads=1)
            true = self._kept([" " + s for s in some], a, b)
            self.known.update((s, None) for s, t in zip(some, true, strict=True) if not t)
            some, a, b = (list(compress(x, true)) for x in (some, a, b))
            if some:
                self.known.update(zip(some, self._aligned(a, b), strict=True))

    def _kept(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Of each text whether both sides' bytes are its own: mostly seen from all texts at once."""
        raw = [t.encode() for t in texts]
        spelled = [[b"".join(map(own.__getitem__, ids)) for ids in side] for own, side in ((self.a_bytes, a), (self.b_bytes, b))]
        if spelled[0] == raw == spelled[1]:
            return [True] * len(raw)
        return [x == r == y for x, r, y in zip(spelled[0], raw, spelled[1], strict=True)]

    def _aligned(self, a_lists: list[list[int]], b_lists: list[list[int]]) -> list[tuple]:
        """What is known of pieces with these tokens, whose bytes lie one after another here.

        Between two neighbouring token ends, of whichever side, lies what one A token and one
        B token share: a link, and all links are found so.  Ends of both sides end a group.
        """
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_lists, b_lists))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_lists, b_lists))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.sort(np.concatenate([ends_a, ends_b]))
        again = ends[1:] == ends[:-1]
        both, ends = ends[1:][again], ends[np.append(True, ~again)]
        links = a[np.searchsorted(ends_a, ends)] << A_SHIFT | b[np.searchsorted(ends_b, ends)]
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        # Spelled tokens with the mark after them: each group's A tokens, then its B tokens.
        last_a, last_b = both[group_a] == ends_a, both[group_b] == ends_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        marks = np.concatenate([np.where(last_a, 1, 0), np.where(last_b, 2, 0)])
        codes = (3 * np.concatenate([a, b]) + marks)[order].tolist()
        spelled = list(map(self.spelled.__getitem__, codes))
        piece_ends = ends_a[np.cumsum(n_a) - 1]
        upto = [np.searchsorted(x, piece_ends, side="right").tolist() for x in (ends, both)]
        raw = links.astype("<i8").tobytes()
        out, at = [], (0, 0, 0)
        for x, y, to_link, to_group in zip(n_a.tolist(), n_b.tolist(), *upto, strict=True):
            token, link, group = at
            out.append(("".join(spelled[token : token + x + y])[:-1], raw[8 * link : 8 * to_link], x, y, to_group - group))
            at = (token + x + y, to_link, to_group)
        return out

    def block(self, keys: pa.Array, texts: list[str], number: int, vector: np.ndarray) -> pa.RecordBatch:
        """The stored rows of a block: each document's pieces, and what the pieces link.

        Adds to ``vector`` the documents of every A id that lies on the B id with its bytes.
        """
        parts = [CUT.split(t) if t else [] for t in texts]
        names = set().union(*parts)
        fresh = names - self.known.keys()
        if len(self.known) + len(fresh) > KNOWN_PIECES:
            self.known = {s: self.known[s] for s in names & self.known.keys()}
        self.learn(list(fresh))
        known = self.known
        if not all(map(known.__getitem__, names)):  # texts with a piece that a tokenizer changes have no tokens
            parts = [p if all(map(known.__getitem__, p)) else [] for p in parts]
            names = set().union(*parts)
        names = list(names)
        found = [known[s] for s in names]
        place = {s: k for k, s in enumerate(names)}
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        words = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
        digests = [hashlib.sha256(";".join([known[s][0] for s in p]).encode()).hexdigest() if p else "" for p in parts]

        links = np.frombuffer(b"".join([f[1] for f in found]), "<i8")
        sizes = np.fromiter((len(f[1]) // 8 for f in found), np.int64, len(found))
        pairs, link_pair = np.unique(links, return_inverse=True)
        documents = np.repeat(np.arange(len(parts)), lengths)
        held = distinct(documents * max(1, len(names)) + words)
        held_doc, held_word = np.divmod(held, max(1, len(names)))
        starts = np.cumsum(sizes) - sizes
        met = link_pair[spread(starts[held_word], sizes[held_word])]
        met = distinct(np.repeat(held_doc, sizes[held_word]) * max(1, len(pairs)) + met) % max(1, len(pairs))
        docs = np.bincount(met, minlength=len(pairs))
        a = pairs >> A_SHIFT
        alike = self.same[a] == (pairs & 0xFFFFFFFF)
        vector[a[alike]] += docs[alike]
        codes = np.where(alike, -1 - a, np.cumsum(~alike) - 1)  # an A id, or a place among the irregular pairs

        counts = [sums(np.fromiter(map(itemgetter(c), found), np.int64, len(found))[words], lengths) for c in (2, 3, 4)]
        kind = np.dtype("<u2" if len(names) < 1 << 16 else "<u4")
        ends = np.cumsum(lengths)
        spelled = words.astype(kind)
        none = [None] * len(parts)
        columns = [
            [number] * (len(parts) + 1), [DOCUMENT] * len(parts) + [PIECES], [*keys.to_pylist(), None],
            *[[*c.tolist(), None] for c in (*counts, sums(sizes[words], lengths))], [*digests, None],
            [*[spelled[e - n : e].tobytes() for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)], codes[link_pair].astype("<i4").tobytes()],
            [*none, sizes.astype("<u4").tobytes()], [*none, pairs[~alike]], [*none, docs[~alike]],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], FIELDS)


def aligner(byte_path: str, piece_path: str) -> Aligner:
    return held_by_worker(f"aligner {byte_path} {piece_path}", lambda: Aligner(byte_path, piece_path))


def blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of three kinds: documents, one row of pieces for each block, one vector for each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        vector = np.zeros(own.size, np.int64)
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1, BLOCK_BYTES):
            with collector_paused():
                yield own.block(batch.column(0), batch.column(1).to_pylist(), number, vector)
            number += 1
        ids = np.flatnonzero(vector)
        row = [number, VECTOR, *[None] * 8, ids, vector[ids]]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], FIELDS)

    return docs.mapInArrow(run, STORED)


def counted(group: pa.Table, answers: pa.Table, alike: np.ndarray, most: np.ndarray) -> pa.Table:
    """The documents of one block with their counts.

    ``alike`` and ``most`` hold, for every A id, the documents in which it lies on the B id
    with its bytes, and those of its most frequent B id.
    """
    kind = group.column("kind").to_numpy()
    group_docs = group.filter(pa.array(kind == DOCUMENT))
    shared = group.filter(pa.array(kind == PIECES)).to_pylist()[0]
    codes, sizes = np.frombuffer(shared["payload"], "<i4"), np.frombuffer(shared["ends"], "<u4").astype(np.int64)
    irregular = np.array(shared["ids"], np.int64)
    counts = np.zeros(len(irregular), np.int64)
    counts[answers.column("pos").to_numpy()] = answers.column("docs").to_numpy()
    regular = codes < 0
    a = np.empty(len(codes), np.int64)
    a[regular], a[~regular] = -1 - codes[regular], irregular[codes[~regular]] >> A_SHIFT
    count = alike[a]
    count[~regular] = counts[codes[~regular]]
    total, best = sums(count, sizes), sums((count == most[a]).astype(np.int64), sizes)
    kind = np.dtype("<u2" if len(sizes) < 1 << 16 else "<u4")
    words = [np.frombuffer(p, kind) for p in group_docs.column("payload").to_pylist()]
    values = {
        "n_best": pa.array([int(best[w].sum()) for w in words], pa.int64()),
        "count_sum": pa.array([int(total[w].sum()) for w in words], pa.int64()),
    }
    names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
    return pa.table([values.get(n, group_docs.column(n) if n not in values else None) for n in names], names=names)


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros, and an
    empty ``groups_sha256``.  Each row is a document of its own, repeated and null keys too.
    ``n_best`` counts links whose pair lies linked in as many documents as any pair of its A
    id.  The paths are the vocabularies' places on the executors.

    Two vectors of the first vocabulary's length pass the driver, whatever the input.
    """
    stored = written(blocks(keyed_texts(docs, key, text), byte_path, piece_path), "aligned")
    exploded = stored.where(F.col("kind") == PIECES).select("block", F.posexplode(F.arrays_zip("ids", "docs")).alias("pos", "p"))
    pairs = exploded.select("block", "pos", F.col("p.ids").alias("pair"), F.col("p.docs").alias("n"))
    totals = written(pairs.groupBy("pair").agg(F.sum("n").alias("docs")), "pairs")
    alike_rows = stored.where(F.col("kind") == VECTOR).select(F.explode(F.arrays_zip("ids", "docs")).alias("p"))
    alike_rows = alike_rows.groupBy(F.col("p.ids").alias("a")).agg(F.sum("p.docs").alias("n")).collect()
    most_rows = totals.groupBy(F.shiftright("pair", A_SHIFT).alias("a")).agg(F.max("docs").alias("n")).collect()
    size = 1 + max([r["a"] for r in alike_rows + most_rows], default=0)
    alike = np.zeros(size, np.int64)
    alike[[r["a"] for r in alike_rows]] = [r["n"] for r in alike_rows]
    most = alike.copy()
    for r in most_rows:
        most[r["a"]] = max(most[r["a"]], r["n"])
    answers = pairs.join(totals, "pair").select(F.col("block").alias("home"), "pos", "docs")
    groups = stored.where(F.col("kind") != VECTOR).groupBy("block").cogroup(answers.groupBy("home"))
    return groups.applyInArrow(lambda group, found: counted(group, found, alike, most), RESULT)
