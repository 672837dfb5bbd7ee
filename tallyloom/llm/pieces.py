"""Ids of single pieces of text, asked of the tokenizers library once.

Both BPE vocabularies split a text by a pattern, map bytes to printable
characters and merge inside each piece. A full ``encode`` of a short word costs
several times what its merges cost, so words of Latin letters (below U+0250,
where no normalization form or Unicode version changes anything) are split
here with the same pattern and handed to the library's BPE model directly.
Everything else goes through the library's ``encode``.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import regex

#: The splitting patterns of the two vocabularies' files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Tokens held of the vocabulary with word ends and of the other one, all forgotten when that many are
#: held, and entries of one generation of a cache of longer pieces (two are held); about 200 bytes an entry.
WORD_TOKENS, BYTE_TOKENS, PIECES = 600_000, 240_000, 120_000
#: Marks that make one token after a word of letters.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_OTHER = re.compile(r"[^\x00-ɏ]|[İ\x85\xa0\x1c-\x1f]|<\|")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Cache:
    """A dict of two generations: what isn't asked for again is dropped."""

    def __init__(self, generation: int = PIECES):
        self.generation = generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.generation:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceEncoder:
    """``lower`` and WORD_PATTERN are for the vocabulary with word ends."""

    def __init__(self, vocab_path: str, words: bool, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.words, self.dtype = words, np.dtype(dtype)
        self.split = regex.compile(WORD_PATTERN if words else BYTE_PATTERN).findall
        self.table = byte_characters()
        self.tokenize = self.model.tokenize
        self.tokens: dict[str, bytes] = {}
        self.most = WORD_TOKENS if words else BYTE_TOKENS
        self.code = {1: "B", 2: "H", 4: "I"}[self.dtype.itemsize]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def piece(self, text: str) -> bytes:
        token = self.token
        if text.isascii():
            if text.isalpha():
                return token(text.lower() if self.words else text)
            if self.words and (core := text.rstrip(MARKS)).isalpha():
                return token(core.lower()) + token(text[len(core) :])
            if "<|" in text or not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return self.library(text)
        elif _OTHER.search(text):
            return self.library(text)
        found = self.split(text.lower() if self.words else text)
        if len(found) == 1:
            return token(found[0])
        return b"".join(map(token, found))

    def token(self, token: str) -> bytes:
        got = self.tokens.get(token)
        if got is None:
            mapped = token if token.isascii() and token.isprintable() and " " not in token else token.encode().decode("latin-1").translate(self.table)
            got = array(self.code, [t.id for t in self.tokenize(mapped)]).tobytes()
            if len(self.tokens) >= self.most:
                self.tokens.clear()
            self.tokens[token] = got
        return got


@lru_cache(maxsize=4)
def shared(vocab_path: str, words: bool, dtype: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker."""
    return PieceEncoder(vocab_path, words, dtype)
