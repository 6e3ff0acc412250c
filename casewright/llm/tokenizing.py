"""Exact library tokenization of whole texts, with each distinct piece encoded once.

A text is cut where the pre-tokenizers of both vocabularies always cut (before white space that a word follows, around
line ends, between an ASCII letter and ASCII punctuation), so the ids of a text are those of its pieces in order. The
library encodes each distinct piece of a batch once; frequent pieces stay in a bounded cache. Texts with white space
outside ASCII, control separators or the start of a special token go to the library whole.

Null texts count as empty; bytes that are not UTF-8 are replaced as the library's caller would have to.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casewright.llm import textblocks as tb
from casewright.llm.work import KEPT

CACHE_PIECES = 500_000
_SPACE = tb.byte_set((0x09, 0x0D), (0x20, 0x20))
_LETTER = tb.byte_set((0x41, 0x5A), (0x61, 0x7A))
_PUNCT = tb.byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # without the apostrophe
_CONTROL = tb.byte_set((0x1C, 0x1F))
#: White space outside ASCII, as UTF-8 (fixed values of Unicode).
_WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def piece_bounds(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a piece begins, by byte; rows begin pieces too."""
    space, letter, punct = _SPACE[buf], _LETTER[buf], _PUNCT[buf]
    cut = np.zeros(len(buf), bool)
    if len(buf) > 1:
        # a run of white space begins; its last member before a word; a word after white space other than a blank
        cut[1:] = space[1:] & ~space[:-1]
        cut[:-1] |= space[:-1] & ~space[1:]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # what ends a text has no word after it
        before = np.zeros(len(ends), bool)
        before[ends > 0] = ~space[ends[ends > 0] - 1]
        cut[ends] = space[ends] & before
        cut[1:] |= ~space[1:] & space[:-1] & (buf[:-1] != 0x20)
        cut[1:] |= (punct[1:] & letter[:-1]) | (letter[1:] & punct[:-1])
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """ids of Arrow text columns by a tokenizers file."""

    def __init__(self, path: str, dtype=np.uint32):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.dtype = dtype
        letters = _byte_letters()
        self.word = re.compile("^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$").match
        probe = ["Word", " word", " \u00c9t\u00e9", "na\u00efve", " The", "a"]
        want = [e.ids for e in self.encode(probe, add_special_tokens=False)]
        #: how the tokenizer's model takes one pre-token of Latin letters, where that is known to give the same ids
        ways = [lambda t: t.encode().decode("latin-1").translate(letters), lambda t: t.strip(" ").lower().encode().decode("latin-1").translate(letters)]
        self.spell = next((f for f in ways if [[x.id for x in self.tokenizer.model.tokenize(f(t))] for t in probe] == want), None)
        self.folds = self.spell is ways[1]
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.used = np.zeros(1 << 16, dtype), np.zeros(1 << 16, np.int64), 0

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        new, rest, tokenize = [None] * len(texts), [], self.tokenizer.model.tokenize
        for k, t in enumerate(texts):
            if self.spell and self.word(t):
                new[k] = [x.id for x in tokenize(self.spell(t))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.encode([texts[k] for k in rest], add_special_tokens=False), strict=True):
            new[k] = e.ids
        n, k = len(self.known), sum(map(len, new))
        while self.used + k > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + k] = np.fromiter((i for x in new for i in x), self.dtype, k)
        self.starts[n + 1 : n + len(new) + 1] = self.used + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        self.used += k
        for p in pieces:
            self.known[p] = len(self.known)

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by row) of rows that may be cut."""
        if self.folds:
            buf = tb.LOWER[buf]
        begin = piece_bounds(buf, offsets)
        ends = np.append(begin, len(buf)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_PIECES:
            self.known.clear()
            self.used = 0
        known = self.known
        new = [p for p in distinct if p not in known]
        if new:
            self._learn(new)
        code = np.fromiter((known[p] for p in distinct), np.int64, len(distinct))[coded.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64)
        size = self.starts[code + 1] - self.starts[code]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(total[-1]) + np.repeat(self.starts[code] - total[:-1], size)
        return self.ids[at], total[np.searchsorted(begin, offsets)]

    def rows(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds by row)."""
        buf, offsets = tb.text_bytes(column)
        text = pc.fill_null(column, "")
        odd = pc.or_(pc.match_substring(text, "<|"), pc.match_substring_regex(text, _WIDE_SPACE)).to_numpy(zero_copy_only=False)
        if _CONTROL[buf].any():
            marks = np.concatenate([[0], np.cumsum(_CONTROL[buf])])
            odd = odd | (marks[offsets[1:]] > marks[offsets[:-1]])
        if not odd.any():
            return self._pieces(buf, offsets)
        parts, sizes = [], []
        for k, whole in enumerate(odd):
            one, off = buf[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])
            if whole:
                ids = np.array(self.encode([one.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.dtype)
            else:
                ids = self._pieces(one, off)[0]
            parts.append(ids)
            sizes.append(len(ids))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def blocks(self, column):
        """(first row, row after the last, ids, bounds) over blocks of rows."""
        _, offsets = tb.text_bytes(column)
        for low, high in tb.row_blocks(offsets, 4 * tb.BLOCK_BYTES):
            yield low, high, *self.rows(column.slice(low, high - low))


def encoder(path: str, dtype=np.uint32) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if (path, dtype) not in KEPT:
        KEPT[path, dtype] = Encoder(path, dtype)
    return KEPT[path, dtype]
