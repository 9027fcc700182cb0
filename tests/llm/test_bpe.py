"""Own byte-pair encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quincunx.llm import bpe, packing, queries, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \n\t ", "one", "Ünïcödé ß Σας ΣΑΣ ﬁ 漢字 😀 it's we'll 1234 ½ ²³", "a" * 5000, "aaaa aaa aaaaaaaa\nline line　x",
    "<|endoftext|> a<|startoftext|>b<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "x\x1cy\x0bz\x85 q\xa0r​s", "é ́ ño",
    "".join(f"w{k} " for k in range(3000)), "ᲉꟋꟜ ՘ ₏͸", "''s 's !'s don't DON'T I'LL", "&#39; </w> Ġ Ċ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Coder(PATH)


def same(own, library, texts):
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text


def test_texts(own, library):
    same(own, library, [t for t in TEXTS if t is not None])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    same(own, library, [text, text.upper(), f"a{text}b<|endoftext|>{text}"])


def test_every_code_point(own, library):
    counter, encoder = tokencount.TextCounter(PATH), packing.TextEncoder(PATH)
    # No later plane has a character that is assigned, but for tags and variation selectors.
    points = [chr(k) for k in (*range(0x33480), *range(0xE0000, 0xE0200)) if not 0xD800 <= k < 0xE000]
    for form in ("{} ", "a{}b "):
        for k in range(0, len(points), 50_000):
            text = "".join(form.format(c) for c in points[k : k + 50_000])
            ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert counter.count([text]) == [len(ids)]
            assert np.frombuffer(encoder.encode([text])[0], encoder.store).tolist() == ids


def test_stale_entries_are_skipped(own):
    # Repeated letters leave overlapping pairs in the queue; their order decides.
    for word in (b"a" * 7, b"abababab", b"thethethe", b"zzzzzz", b"a"):
        ids = own.merged(word)
        assert b"".join(own.strings[i] for i in ids) == word + b"</w>" and ids == own.merged(word)


def test_little_memory_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 3)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 2)
    coder = bpe.Coder(PATH)
    for _ in range(2):
        for text in TEXTS[1:]:
            same(coder, library, [text])


def test_rows(spark, library):
    table = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "two"), (None, None)]
    df = spark.createDataFrame([(t, k, 1, "x", 2) for k, t in table], "text string, doc_id long, n_tokens int, ids string, decoded int")

    def expected(key, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        return (-1 if key is None else key, len(ids), raw, decoded)

    want = sorted(expected(*r) for r in table)
    rows = bpe.coded(df, PATH).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    sha = lambda data: hashlib.sha256(data).hexdigest()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    assert found == sorted((k, n, sha(i), sha(d)) for k, n, i, d in want)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_given_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op13_bpe(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
