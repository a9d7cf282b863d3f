"""Byte-level BPE by pieces: the split that precedes the merges, and the ids of pieces from bounded caches.

Merges never cross a piece, so a text's ids are those of its pieces one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

#: Letters, numbers, white space and the rest in terms of ``re``, each with a character of its kind. ``re`` is several times as
#: fast as engines that know Unicode's own classes; where it differs from them is found by Pieces.
KINDS = (("a", r"[^\W\d_]"), ("1", r"\d"), ("\t", r"\s"), ("!", r"(?:[^\s\w]|_)"))
_LETTER, _NUMBER, _SPACE, _OTHER = (p for _, p in KINDS)
#: The split of byte-level tokenizers with ``use_regex``; alternatives begin with different characters, letters are tried first.
PATTERN = rf" ?{_LETTER}+|'(?:[stmd]|re|ve|ll)| ?{_NUMBER}+| ?{_OTHER}+|{_SPACE}+(?!\S)|{_SPACE}+"
#: Longer pieces are encoded again wherever they stand, so that caches hold short ones only.
LONGEST = 64


def load_json(path: str, special_as_text: bool = False):
    """The library's tokenizer, without truncation and padding, and without threads beside a task's own."""
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = special_as_text
    return tok


def splits_by_pattern(path: str) -> bool:
    """Whether a tokenizer file splits by PATTERN alone, with nothing before it."""
    import json

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    pre = own.get("pre_tokenizer") or {}
    return own.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


class Pieces:
    """text -> its pieces. Two libraries may class a rare character in two ways; each character is therefore probed once
    in the tokenizer's own split, and texts with one that differs are split there."""

    def __init__(self, tok):
        self.own, self.split = tok.pre_tokenizer.pre_tokenize_str, re.compile(PATTERN).findall
        self.kinds = [(a, re.compile(p).fullmatch) for a, p in KINDS]
        self.same: set[str] = set()
        self.odd: set[str] = set()
        self._probe(map(chr, range(128)))
        self.odd_ascii = sorted(self.odd)

    def _probe(self, chars) -> None:
        for c in chars:
            same = all((len(self.own(a + c)) == 1) == (of(c) is not None) for a, of in self.kinds)
            (self.same if same else self.odd).add(c)

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() or any(c in text for c in self.odd_ascii):
            other = set(text) - self.same
            if other:
                self._probe(other - self.odd)
                if other & self.odd:
                    return [text[s:e] for _, (s, e) in self.own(text)]
        return self.split(text)


class Ids(dict):
    """piece -> its number, given at first sight; ``of`` gives the ids of lists of pieces. New pieces of a call are encoded
    at once, by ``encode`` (pieces to lists of ids). Besides those of one call it holds no more than ``kept``."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], kept: int = 300_000):
        super().__init__()
        self.encode, self.kept = encode, kept
        self._start()

    def _start(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def of(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several lists of pieces in a row, and how many each has."""
        if len(self) > self.kept:
            self._start()
        n = np.concatenate([np.empty(0, np.int64), *[np.fromiter(map(self.__getitem__, p), np.int64, len(p)) for p in pieces]])
        if self.new:
            found = self.encode(self.new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.new = []
        sizes = self.starts[n + 1] - self.starts[n]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[n] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[at], np.diff(ends[np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])])


def byte_of(alphabet: str) -> int:
    """The byte that a character of byte-level vocabularies stands for: printable Latin-1 itself, others from U+0100 on in order."""
    return _BYTES[alphabet]


_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
