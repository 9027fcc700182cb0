"""Removal of repeated passages by sorting suffixes, deep-shallow.

A passage of ``length`` bytes is found where it starts in a document with a smaller id.
Sorting every suffix of a corpus would move ``length`` times its size, so suffixes are
sampled: each window of ``length`` bytes has an anchor, the position inside it where a hash
of the next bytes is smallest.  Equal windows have equal anchors, so only windows around
anchors that several documents share can repeat; about a fifth of all anchors in corpora
with copies, and one byte in fourteen is an anchor.

1. Each block of documents sends its anchors' hashes to buckets, which answer which of them
   occur in several documents.
2. Blocks send the text around those anchors.  A bucket sorts it, which joins equal
   surroundings; around anchors with several surroundings it sorts the windows themselves.
   The answer says which windows start in a smaller document.
3. Blocks cut the covered bytes.

Sorting is deep-shallow: multikey quicksort on symbols of eight bytes down to a shallow
depth, then blind tries for the groups that still agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import keyed_texts

BLOCK_BYTES = 4 << 20
PART_BYTES = 1 << 20  # of a block's text held in wide arrays at a time
BUCKET_BLOCKS = 4  # as many buckets as blocks, divided by this
HOT_DOCUMENTS = 5_000  # an anchor in more documents is dealt out window by window
SHALLOW = 5  # symbols of eight bytes

MIX = np.uint64(0x9E3779B97F4A7C15)
NOBODY = np.iinfo(np.int64).max


# --- deep-shallow sorting ---------------------------------------------------------


def deep_shallow(symbols: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``symbols`` (n x w unsigned words), and where runs of equal rows start.

    The shallow part is multikey quicksort with all segments at once: every round sorts the
    open segments by their next symbol, and rows that agree with a neighbour stay open.
    """
    n, width = symbols.shape
    new = np.zeros(n, bool)
    if not n:
        return np.arange(n), np.zeros(0, np.int64)
    new[0] = True
    order = np.argsort(symbols[:, 0])
    key = symbols[order, 0]
    new[1:] = key[1:] != key[:-1]
    for depth in range(1, min(shallow, width)):
        open_rows = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(open_rows):
            break
        segment, key = np.cumsum(new)[open_rows], symbols[order[open_rows], depth]
        by = _within(segment, key)
        order[open_rows] = order[open_rows][by]
        key = key[by]
        new[open_rows[1:]] |= (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])
    deep = np.flatnonzero(~new) if width > shallow else np.zeros(0, np.int64)
    differs = deep[(symbols[order[deep], shallow:] != symbols[order[deep - 1], shallow:]).any(axis=1)]
    starts = np.append(np.flatnonzero(new), n)
    mixed = np.unique(np.searchsorted(starts, differs, side="right") - 1)
    for s, e in zip(starts[mixed].tolist(), starts[mixed + 1].tolist(), strict=True):
        rows = order[s:e].copy()
        strings, wide = symbols[rows, shallow:].astype(">u8").tobytes(), 8 * (width - shallow)
        at = s
        for leaf in blind_trie([strings[k : k + wide] for k in range(0, len(strings), wide)]):
            order[at : at + len(leaf)] = rows[leaf]
            new[at] = True
            at += len(leaf)
    return order, np.flatnonzero(new)


def _within(segment: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by key inside segments, which are in order already."""
    by = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[by] = np.append(0, np.cumsum(np.diff(key[by]) != 0))
    return np.argsort(segment * (rank[by[-1]] + 1) + rank)


def blind_trie(strings: list[bytes]) -> Iterable[list[int]]:
    """Groups of equal strings (all of one length) in order.

    Inner nodes hold only the position in which their strings first differ.  A new string
    goes down blindly to some leaf, is compared with it once, and branches off where the
    two first differ.
    """
    size = len(strings[0]) * 8
    root: list = [None, [0]]  # a leaf: None and rows; an inner node: position and children
    for row in range(1, len(strings)):
        new = strings[row]
        node = root
        while node[0] is not None:
            children = node[1]
            node = children.get(new[node[0]]) or next(iter(children.values()))
        other = strings[node[1][0]]
        if new == other:
            node[1].append(row)
            continue
        apart = (size - (int.from_bytes(new) ^ int.from_bytes(other)).bit_length()) // 8
        node = root
        while node[0] is not None and node[0] < apart:
            node = node[1][new[node[0]]]
        if node[0] == apart:
            node[1][new[apart]] = [None, [row]]
        else:
            node[0], node[1] = apart, {other[apart]: [node[0], node[1]], new[apart]: [None, [row]]}
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node[0] is None:
            yield node[1]
        else:
            waiting += [node[1][b] for b in sorted(node[1], reverse=True)]


def _words(text: np.ndarray, at: np.ndarray, sizes: np.ndarray | int, count: int) -> np.ndarray:
    """Symbols of the strings text[at : at + sizes], most significant byte first, zeros after them.

    ``text`` must go on for 8 bytes after the last string.
    """
    eights = every_eight(text, ">u8")
    out = np.empty((len(at), count), np.uint64, order="F")
    for k in range(count):
        drop = 64 - 8 * np.clip(sizes - 8 * k, 0, 8)
        word = eights[np.minimum(at + 8 * k, len(eights) - 1)]
        if np.any(drop):
            bits = np.asarray(drop % 64, np.uint64)
            word = np.where(drop == 64, np.uint64(0), (word >> bits) << bits)
        out[:, k] = word
    return out


def every_eight(text: np.ndarray, kind: str) -> np.ndarray:
    """The word of eight bytes at each position."""
    out = np.empty(len(text) - 7, np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = text[k : k + (len(text) - k) // 8 * 8].view(kind)
    return out


def _sliding(values: np.ndarray, window: int, choose) -> np.ndarray:
    span = 1
    while 2 * span <= window:
        values = choose(values[:-span], values[span:])
        span *= 2
    rest = window - span
    return choose(values[:-rest], values[rest:]) if rest else values


class Part:
    """Some documents of a block with their anchors: where, the hash of the seed there, and the
    first and last start of a window that the anchor stands for."""

    def __init__(self, texts: list[bytes], length: int, seed: int):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text = np.frombuffer(b"".join(texts) + bytes(max(2 * length, 64)), np.uint8)
        self.ends = np.cumsum(self.sizes)
        total, windows = int(self.sizes.sum()), length - seed + 1
        self.place = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        self.first = self.last = self.document = self.place
        if total < length:
            return
        hashes = seed_hash(self.text, None, total - seed + 1, seed)
        rank = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(rank, windows, np.minimum)
        # Windows across the end of a document don't count; no rank is 0.
        for end in self.ends[:-1].tolist():
            least[max(0, end - length + 1) : end] = 0
        edge = np.zeros(windows - 1, np.uint32)
        most = _sliding(np.concatenate([edge, least, edge]), windows, np.maximum)
        self.place = np.flatnonzero(most == rank)
        # 48 bits tell anchors apart well enough: two that agree are compared by their text.
        self.hash = hashes[self.place] >> np.uint64(16)
        self.least, self.rank, self.windows = least, rank, windows
        self.document = np.searchsorted(self.ends, self.place, side="right")

    def extents(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start of the chosen anchors."""
        place = self.place[chosen]
        starts = place[:, None] - np.arange(self.windows - 1, -1, -1)
        inside = (starts >= 0) & (starts < len(self.least))
        own = inside & (self.least[np.clip(starts, 0, len(self.least) - 1)] == self.rank[place][:, None])
        first = starts[np.arange(len(place)), own.argmax(axis=1)]
        return first, first + own.sum(axis=1) - 1


def seed_hash(text: np.ndarray, at: np.ndarray | None, count: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``seed`` bytes (a multiple of 8) at each position, or from 0 to ``count``."""
    eights = every_eight(text, "<u8")
    out = np.zeros(count if at is None else len(at), np.uint64)
    for k in range(0, seed, 8):
        out ^= eights[k : k + count] if at is None else eights[at + k]
        out *= MIX
        out ^= out >> np.uint64(32)
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


# --- the three steps --------------------------------------------------------------


class Steps:
    """The work of blocks and buckets; all of it is a function of a block's set of documents."""

    def __init__(self, length: int, buckets: int, hot: int):
        self.length, self.buckets, self.hot = length, buckets, hot
        self.seed = max(8, length // 2 // 8 * 8)
        self.windows = length - self.seed + 1
        self.symbols = -(-(2 * length - self.seed) // 8)

    def parts(self, table: pa.Table) -> Iterable[tuple[list, list[bytes], Part]]:
        """The block's documents in order of id and text, some at a time."""
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids, texts, held = [], [], 0
        for batch in table.select(["doc_id", "text"]).to_batches(max_chunksize=4096):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                if held and held + len(raw) > PART_BYTES:
                    yield ids, texts, Part(texts, self.length, self.seed)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield ids, texts, Part(texts, self.length, self.seed)

    def block_hashes(self, parts: Iterable) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes of a block, and in how many of its documents each occurs."""
        found, own = [], []
        for ids, _, part in parts:
            usable = np.array([i is not None for i in ids])[part.document] if len(part.place) else np.zeros(0, bool)
            own_hash, document = part.hash[usable], part.document[usable]
            order = np.argsort(own_hash, kind="stable")  # documents stay in order
            own_hash, document = own_hash[order], document[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (own_hash[1:] != own_hash[:-1]) | (document[1:] != document[:-1])
            hashes, count = np.unique(own_hash[fresh], return_counts=True)
            found.append(hashes)
            own.append(count)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes, where = np.unique(np.concatenate(found), return_inverse=True)
        return hashes, np.bincount(where, np.concatenate(own), len(hashes)).astype(np.int64)

    def ask(self, table: pa.Table) -> pa.Table:
        """Step 1, a block: its hashes for each bucket."""
        block = table.column("block")[0]
        hashes, count = self.block_hashes(self.parts(table))
        out = []
        for bucket, own in _split(_bucket(hashes, self.buckets)):
            out.append((bucket, block.as_py(), _six_bytes(hashes[own]), np.minimum(count[own], 1 << 30).astype("<i4").tobytes()))
        return _table(out, ["bucket", "block", "hashes", "counts"])

    def answer(self, table: pa.Table) -> pa.Table:
        """Step 1, a bucket: for each block's hashes 0 (one document), 1 (several) or 2 (hot)."""
        lists = [_from_six_bytes(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<i4") for x in table.column("counts").to_pylist()])
        _, where = np.unique(np.concatenate(lists), return_inverse=True)
        documents = np.bincount(where, counts)
        code = (1 + (documents > self.hot))[where] * (documents > 1)[where]
        cut = np.cumsum([len(x) for x in lists])[:-1]
        out = [
            (block, bucket, c.astype(np.uint8).tobytes())
            for block, bucket, c in zip(
                table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(code, cut), strict=True
            )
        ]
        return _table(out, ["block", "bucket", "codes"])

    def codes(self, parts: list, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct hashes, and what the buckets said of each."""
        hashes, _ = self.block_hashes(parts)
        code = np.zeros(len(hashes), np.uint8)
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist(), strict=True))
        for bucket, own in _split(_bucket(hashes, self.buckets)):
            code[own] = np.frombuffer(told[bucket], np.uint8)
        return hashes, code

    def surroundings(self, part: Part, hashes: np.ndarray, code: np.ndarray, ids: list):
        """(anchors, start, size, offset, hot): the text to compare for each repeated anchor.

        An ordinary one has all its windows in one stretch of text, with ``offset`` telling
        where in it the seed is; around a hot one each window is a stretch of its own.
        """
        if not len(part.place) or not len(hashes):
            return (np.zeros(0, np.int64),) * 5
        usable = np.array([i is not None for i in ids])[part.document]
        at = np.minimum(np.searchsorted(hashes, part.hash), max(0, len(hashes) - 1))
        said = np.where(usable & (hashes[at] == part.hash), code[at], 0)
        plain, hot = np.flatnonzero(said == 1), np.flatnonzero(said == 2)
        first, last = part.extents(plain)
        h_first, h_last = part.extents(hot)
        many = h_last - h_first + 1
        anchors = np.repeat(hot, many)
        single = np.repeat(h_first, many) + np.arange(len(anchors)) - np.repeat(np.cumsum(many) - many, many)
        flag = np.zeros(len(plain) + len(anchors), bool)
        flag[len(plain) :] = True
        return (
            np.concatenate([plain, anchors]),
            np.concatenate([first, single]),
            np.concatenate([last - first + self.length, np.full(len(anchors), self.length)]),
            np.concatenate([part.place[plain] - first, np.zeros(len(anchors), np.int64)]),
            flag,
        )

    def stretches(self, table: pa.Table, answers: pa.Table):
        """The block's distinct stretches in a fixed order: symbols, meta, smallest id; and the
        stretches of each part as numbers into them."""
        parts = list(self.parts(table))
        hashes, code = self.codes(parts, answers)
        symbols, keys, own = [], [], []
        for ids, texts, part in parts:
            anchors, start, size, offset, hot = self.surroundings(part, hashes, code, ids)
            meta = (size * 256 + offset) * 2 + hot
            symbols.append(np.column_stack([_words(part.text, start, size, self.symbols), meta.astype(np.uint64)]))
            number = np.array([NOBODY if i is None else i for i in ids], np.int64)
            keys.append(number[part.document[anchors]] if len(anchors) else np.zeros(0, np.int64))
            own.append((ids, texts, part, start, size - self.length + 1, keys[-1]))
        symbols = np.concatenate(symbols) if symbols else np.zeros((0, self.symbols + 1), np.uint64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order, starts = deep_shallow(symbols)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        least = np.minimum.reduceat(keys[order], starts) if len(starts) else keys
        return symbols[order[starts]], least, kind, own

    def where_to(self, symbols: np.ndarray) -> np.ndarray:
        """The bucket of each stretch: that of its seed, or of its content where hot."""
        size, offset, hot = _meta(symbols)
        raw = _text(symbols)
        row = np.arange(len(symbols)) * 8 * self.symbols
        seeds = seed_hash(raw, row + offset, 0, self.seed)
        content = seed_hash(raw, row, 0, self.length // 8 * 8) ^ symbols[:, self.length // 8]
        return _bucket(np.where(hot, content, seeds), self.buckets)

    def send(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Step 2, a block: its distinct stretches for each bucket, the smallest id with each."""
        block = table.column("block")[0].as_py()
        symbols, least, _, _ = self.stretches(table, answers)
        size, _, _ = _meta(symbols)
        raw, meta = _text(symbols)[:-64].reshape(len(symbols), 8 * self.symbols), symbols[:, -1]
        out = []
        for bucket, own in _split(self.where_to(symbols)):
            used = np.arange(raw.shape[1])[None, :] < size[own, None]
            out.append((bucket, block, raw[own][used].tobytes(), meta[own].astype("<u4").tobytes(), least[own].astype("<i8").tobytes()))
        return _table(out, ["bucket", "block", "text", "meta", "least"])

    def sort(self, table: pa.Table) -> pa.Table:
        """Step 2, a bucket: for each stretch the windows that start in a smaller document, as bits,
        and the smallest document with the whole stretch."""
        metas = [np.frombuffer(x, "<u4") for x in table.column("meta").to_pylist()]
        meta = np.concatenate(metas).astype(np.int64)
        least = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("least").to_pylist()])
        size = meta >> 9
        text = np.frombuffer(b"".join(table.column("text").to_pylist()) + bytes(8 * self.symbols + 8), np.uint8)
        symbols = _words(text, np.cumsum(size) - size, size, self.symbols)
        order, starts = deep_shallow(np.column_stack([symbols, meta.astype(np.uint64)]))
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        owner = np.minimum.reduceat(least[order], starts)
        covered = self.shared_windows(symbols[order[starts]], meta[order[starts]], owner)
        # A later document has every window of a stretch from the first one.
        bits = np.where(least > owner[kind], np.uint64((1 << self.windows) - 1), covered[kind])
        cut = np.cumsum([len(m) for m in metas])[:-1]
        out = [
            (block, bucket, b.astype("<u8").tobytes())
            for block, bucket, b in zip(
                table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(bits, cut), strict=True
            )
        ]
        return _table(out, ["block", "bucket", "bits"])

    def shared_windows(self, symbols: np.ndarray, meta: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each distinct stretch the windows that another one with a smaller owner has too."""
        size, offset = meta >> 9, (meta >> 1) & 255
        covered = np.zeros(len(symbols), np.uint64)
        raw = _text(np.column_stack([symbols, np.zeros(len(symbols), np.uint64)]))
        row = np.arange(len(symbols)) * 8 * self.symbols
        seeds = seed_hash(raw, row + offset, 0, self.seed)
        plain = np.flatnonzero((meta & 1) == 0)
        _, where, count = np.unique(seeds[plain], return_inverse=True, return_counts=True)
        several = plain[count[where] > 1]
        many = (size - self.length + 1)[several]
        stretch = np.repeat(several, many)
        at = np.arange(len(stretch)) - np.repeat(np.cumsum(many) - many, many)
        windows = _words(raw, row[stretch] + at, self.length, -(-self.length // 8))
        order, starts = deep_shallow(windows)
        if not len(starts):
            return covered
        least = np.minimum.reduceat(owner[stretch[order]], starts)
        least = np.repeat(least, np.diff(np.append(starts, len(order))))
        later = least < owner[stretch[order]]
        np.bitwise_or.at(covered, stretch[order[later]], np.uint64(1) << at[order[later]].astype(np.uint64))
        return covered

    def cut(self, table: pa.Table, answers: pa.Table, windows: pa.Table) -> pa.Table:
        """Step 3, a block: what remains of each document."""
        symbols, least, kind, own = self.stretches(table, answers)
        bits = np.zeros(len(symbols), np.uint64)
        told = dict(zip(windows.column("bucket").to_pylist(), windows.column("bits").to_pylist(), strict=True))
        for bucket, mine in _split(self.where_to(symbols)):
            bits[mine] = np.frombuffer(told[bucket], "<u8")
        done, out = 0, []
        for ids, texts, part, start, many, keys in own:
            mine = kind[done : done + len(start)]
            done += len(start)
            # In a block, too, a later document has every window from the first one.
            said = np.where(keys > least[mine], np.uint64((1 << self.windows) - 1), bits[mine])
            change = np.zeros(len(part.text) + 1, np.int64)
            for k in range(self.windows):
                hit = start[(k < many) & (said >> np.uint64(k) & np.uint64(1) > 0)] + k
                np.add.at(change, hit, 1)
                np.add.at(change, hit + self.length, -1)
            gone = np.cumsum(change[:-1]) > 0
            for key, text, end in zip(ids, texts, part.ends.tolist(), strict=True):
                inside = gone[end - len(text) : end]
                removed = int(inside.sum())
                kept = np.frombuffer(text, np.uint8)[~inside].tobytes() if removed else text
                spans = int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum()) if removed else 0
                out.append((key, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        return _table(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


TYPES = {
    "bucket": pa.int64(), "block": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "codes": pa.binary(),
    "text": pa.binary(), "meta": pa.binary(), "least": pa.binary(), "bits": pa.binary(), "doc_id": pa.int64(),
    "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string(),
}


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, TYPES[n]) for n, c in zip(names, columns, strict=True)})


def _six_bytes(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _split(numbers: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    """Each distinct number with the positions that hold it, in order."""
    if not len(numbers):
        return
    order = np.argsort(numbers, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(numbers[order]) != 0))
    for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(numbers[order[s]]), order[s:e]


def _meta(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    meta = symbols[:, -1].astype(np.int64)
    return meta >> 9, (meta >> 1) & 255, (meta & 1).astype(bool)


def _text(symbols: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, each padded to whole symbols, and some zeros."""
    raw = np.ascontiguousarray(symbols[:, :-1].astype(">u8")).view(np.uint8).ravel()
    return np.append(raw, np.zeros(64, np.uint8))


def without_repeats(
    docs: DataFrame, length: int = 50, *, hot: int = HOT_DOCUMENTS, block_bytes: int = BLOCK_BYTES, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row.

    Each byte goes that lies in a string of ``length`` bytes (16 to 64) which also starts in
    a row with a smaller doc_id; n_spans counts the maximal runs removed.  Null texts are
    empty.  Rows with a null doc_id lose nothing and take nothing from others, and rows of
    one doc_id don't shorten each other.  ``kept_text`` has U+FFFD where a cut split a
    character; the digest is of the exact bytes.

    The texts are dealt into blocks once, and all three steps read that one shuffle.
    """
    if not 16 <= length <= 64:
        raise ValueError("a length of 16 to 64 bytes")
    rows = keyed_texts(docs, key, text)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    steps = Steps(length, max(1, -(-blocks // BUCKET_BLOCKS)), hot)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def each_block(function, others: DataFrame, schema: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(function, schema)

    # Spark tells how to call a function by its number of arguments, hence no bound methods.
    asked = dealt.groupBy("block").applyInArrow(lambda t: steps.ask(t), "bucket long, block long, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(lambda t: steps.answer(t), "block long, bucket long, codes binary")
    sent = each_block(lambda t, said: steps.send(t, said), answers, "bucket long, block long, text binary, meta binary, least binary")
    sorted_ = sent.groupBy("bucket").applyInArrow(lambda t: steps.sort(t), "block long, bucket long, bits binary")
    told = answers.selectExpr("block", "bucket", "codes", "CAST(NULL AS binary) AS bits").unionByName(
        sorted_.selectExpr("block", "bucket", "CAST(NULL AS binary) AS codes", "bits")
    )

    def finish(table: pa.Table, said: pa.Table) -> pa.Table:
        first = said.filter(pa.compute.is_valid(said.column("codes")))
        second = said.filter(pa.compute.is_valid(said.column("bits")))
        return steps.cut(table, first, second)

    return each_block(
        finish, told, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
