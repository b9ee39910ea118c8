"""Ids of byte-level and of piece BPE over whole texts, from remembered ids of their parts.

The vocabulary's pattern always begins a new word at a space that something other than white space follows, and at a mark
after a letter, so a text may be cut there and its parts encoded apart. A piece holds spaces at its beginning alone, so for pieces
a text may be cut before each run of spaces. Parts are remembered by worker as those of ``packing.WordTokenizer``:
found by a hash, their bytes compared.
"""

from __future__ import annotations

import numpy as np

from .packing import WordTokenizer

#: Bytes after a space that surely begin no white space: visible ASCII, and first bytes of characters of which none is white space.
_OPEN = np.zeros(256, dtype=bool)
_OPEN[0x21:0x7F] = _OPEN[0xC3:] = True
_OPEN[0xE1:0xE4] = False
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[0x21:0x7F] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False


class ByteTokenizer(WordTokenizer):
    """``vocabulary`` is the text of a tokenizer's file. With ``special`` False, special tokens' strings in texts are plain text."""

    def __init__(self, vocabulary: str, special: bool = True):
        super().__init__(vocabulary)
        self.special = special
        self.tokenizer.encode_special_tokens = not special

    @staticmethod
    def _folded(buf: np.ndarray) -> np.ndarray:
        return buf

    def _ids(self, parts: list[bytes]) -> list[list[int]]:
        """A space and ASCII letters are one word of the pattern; others go through all of the tokenizer."""
        got: list = [None] * len(parts)
        other = []
        for i, p in enumerate(parts):
            if p[1:].isalpha() and (p[0] == 32 or p[:1].isalpha()):
                got[i] = [t.id for t in self.model.tokenize(p.decode().replace(" ", "Ġ"))]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch([parts[i].decode("utf-8", "replace") for i in other], add_special_tokens=False), strict=True):
            got[i] = e.ids
        return got

    def _parts(self, low: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of what begins with a text, such a space or such a mark; together they hold every byte."""
        first = np.zeros(len(buf) + 1, dtype=bool)
        if len(buf) > 1:
            first[:-2] = (buf[:-1] == 32) & _OPEN[buf[1:]]
            first[off[1:] - 1] = False  # a text's last space, whatever the next one begins with
            first[1:-1] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
        first[off[:-1][np.diff(off) > 0]] = True
        first[-1] = False
        start = np.flatnonzero(first)
        return start, np.append(start[1:], off[-1])[: len(start)]

    def _entangled(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows of texts that may hold the string of a special token."""
        if not self.special or len(buf) < 2:
            return np.zeros(0, np.int64)
        return np.unique(np.searchsorted(off, np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C)), "right") - 1)


class PieceTokenizer(WordTokenizer):
    """Ids of the model's pieces (no normaliser, a space put before) for texts that have this space before them already.

    Texts that hold U+2581 itself get other ids than whole; their tokens don't give their bytes either way.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_proto=model)
        self.space = self.pieces.piece_to_id("\u2581")
        self.clear()

    @staticmethod
    def _folded(buf: np.ndarray) -> np.ndarray:
        return buf

    def _ids(self, parts: list[bytes]) -> list[list[int]]:
        got = self.pieces.encode([p[1:].decode("utf-8", "replace") for p in parts], num_threads=1)
        return [ids if len(p) > 1 else [self.space] for p, ids in zip(parts, got, strict=True)]

    def _whole(self, text: str) -> list[int]:
        return self._ids([text.encode()])[0]

    def _parts(self, low: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(buf) + 1, dtype=bool)
        first[1:-1] = (buf[1:] == 32) & (buf[:-1] != 32)
        first[off[:-1][np.diff(off) > 0]] = True
        first[-1] = False
        start = np.flatnonzero(first)
        return start, np.append(start[1:], off[-1])[: len(start)]

    def _entangled(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.int64)
