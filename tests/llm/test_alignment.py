"""Cross-tokenizer alignment against both libraries on whole texts and counts in a dictionary."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quincunx.llm import alignment, queries
from quincunx.llm.words import byte_symbols

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
FOLDER = "/root/testdata/sf0.001"
LINE = "the quick brown fox jumps over the lazy dog, while seven wizards box near the quay again. "
TEXTS = [
    None, "", " ", "   ", "one", " one  two   three ", LINE * 20, "Ünïcödé ß Σας ﬁ 漢字 😀 it's we'll 1234 ½", "a" * 3000, "aaaa aaa aaaaaaaa aa a",
    "under▁score", "plain text beside ▁", "<s> </s> <unk> <0x41> <|endoftext|> end", "tab\there\nline one\n line two\r\n  x　y ​ z ᠎ w ﻿ v",
    "é ́ x\x00y \x1c \x85", "deadbeefdeadbeef " * 50, " ".join(f"w{k}" for k in range(2500)), "the",
]


class Whole:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.value = {c: k for k, c in enumerate(byte_symbols())}

    def tokens(self, text):
        """Lists of (id, start, end) of both, or nothing."""
        if not text:
            return [], []
        raw, out = (" " + text).encode(), []
        for ids, spell in (
            (self.a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(self.value[c] for c in self.a.id_to_token(i))),
            (self.b.encode(text), lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            at, tokens, joined = 0, [], b""
            for i in ids:
                piece = spell(i)
                tokens.append((i, at, at + len(piece)))
                at, joined = at + len(piece), joined + piece
            if joined != raw:
                return [], []
            out.append(tokens)
        return out

    def linked(self, text):
        a, b = self.tokens(text)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        inside = [defaultdict(list), defaultdict(list)]  # by the number of the group's end
        for held, side in zip(inside, (a, b), strict=True):
            for i, _, e in side:
                held[bisect.bisect_left(ends, e)].append(str(i))
        groups = ["|".join(",".join(held[k]) for held in inside) for k in range(len(ends))]
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        return a, b, groups, links


@pytest.fixture(scope="module")
def whole():
    return Whole()


def brute(whole, table):
    found = [(key, *whole.linked(text)) for key, text in table]
    count = Counter(pair for *_, links in found for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(
        (-1 if key is None else key, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for key, a, b, groups, links in found
    )


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("block, known", [(4 << 20, 300_000), (200, 4)])
def test_rows(spark, whole, monkeypatch, block, known):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "KNOWN_PIECES", known)
    monkeypatch.setattr(alignment, "PIECES_AT_ONCE", 50)
    rng = random.Random(4)
    letters = ["the", "th", "een", "q", "zx", " ", "  ", "\n", "'s", "aa", "é", "12", ",", "-", "▁" if block == 200 else "_"]
    table = [(k, t) for k, t in enumerate(TEXTS)] + [(4, "one"), (4, "one"), (None, LINE), (None, None)]
    table += [(1000 + k, "".join(rng.choices(letters, k=rng.randrange(60)))) for k in range(120)] + [(2000 + k, LINE * 2) for k in range(40)]
    df = spark.createDataFrame([(t, k, 1, 2, "p", 3) for k, t in table], "text string, doc_id long, block int, n_a int, ids string, kind int")
    assert got(alignment.token_alignment(df.repartition(5), A, B)) == brute(whole, table)


def test_no_rows(spark):
    assert alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(alignment.token_alignment(only, A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ​'se12aA.,▁"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_pieces_have_the_tokens_of_the_whole(whole, text):
    own = _aligner()
    parts = alignment.CUT.split(text) if text else []
    own.learn([p for p in parts if p not in own.known])
    found = [own.known[p] for p in parts]
    a, b, groups, links = whole.linked(text)
    if any(f is None for f in found):
        assert not a
    else:
        assert ";".join(f[0] for f in found) == ";".join(groups) and sum(f[2] for f in found) == len(a) and sum(f[3] for f in found) == len(b)
        assert sum(len(f[1]) // 8 for f in found) == len(links)


_held = []


def _aligner():
    if not _held:
        _held.append(alignment.Aligner(A, B))
    return _held[0]


def test_no_token_of_b_holds_an_inner_space():
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    assert not any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size()))


def test_given_documents(spark, whole):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got(queries.op12_alignment(spark, FOLDER)) == brute(whole, table)
