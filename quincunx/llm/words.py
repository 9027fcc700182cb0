"""Texts to the words between which a vocabulary merges nothing.

Words of ASCII and Latin letters are split here; where tables of characters may differ
between versions of Unicode, the vocabulary's own normaliser and splitter are asked.
"""

from __future__ import annotations

import re

from tokenizers import Tokenizer

# White space as the vocabulary's normaliser sees it: controls, and the spaces of Unicode.
WIDE_SPACES = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = re.compile(f"[\t-\r {WIDE_SPACES}]+")
ODD_CONTROLS = "\x1c\x1d\x1e\x1f"  # white space to str.split alone
# The split pattern of the vocabulary within Latin letters.
LATIN_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b if b in set(printable) else 256 + rest.index(b)) for b in range(256)]


def latin(text: str) -> bool:
    """Whether all characters are below 256: such text is composed, and its characters lower alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Texts to chunks without white space, and chunks to words, as one vocabulary has them."""

    def __init__(self, library: Tokenizer):
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}

    def chunks(self, text: str) -> list[str]:
        """The library lowers each character alone, and no character joins others across white space."""
        if latin(text):
            text = text.lower()
        return [c for c in SPACE.split(text) if c] if any(map(text.__contains__, ODD_CONTROLS)) else text.split()

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk, normalised, as UTF-8."""
        if latin(chunk):
            return [p.encode() for p in LATIN_PIECE.findall(chunk.lower())]
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(map(self.bytes.__getitem__, spelled)) for spelled, _ in pieces]
