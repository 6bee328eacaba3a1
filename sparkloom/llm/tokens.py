"""Exact token ids of whole texts at the speed of a dictionary: a text is cut as the tokenizer's own pattern cuts it, and each distinct piece is encoded once."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from sparkloom.llm import common

#: Letters that both patterns call letters, that stay as they are in NFC and have a lower case of one character.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = " \\t\\n\\x0b\\x0c\\r"
#: Plain text: ASCII, those letters, and some marks of print that are neither letter, digit nor white space.
_ODD = re.compile(f"[^\\x00-\\x7f{_LETTER}¡«»¿–—‘-„…]")
#: The two tokenizers' own patterns, for plain text.
_PATTERNS = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_BLANK}{_LETTER}0-9]+"),
}
#: White space beyond ASCII, as tokenizers' \s has it: fixed values.
_WIDE_SPACE = re.compile("[\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_LOADED: dict[tuple, "UnitEncoder"] = {}


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


class UnitEncoder:
    """Encodes with a `tokenizers` file, remembering the ids of pieces.

    Plain text is cut here by the tokenizer's own pattern, and its model encodes each new piece. Other text falls into
    units between blanks, where the pattern never joins (`keep_blank`: as long as no other white space is beside the
    blank; else it is encoded in one go), and only the units that are not plain go through the whole tokenizer. A worker
    keeps up to `most` new pieces and as many older ones, and forgets those not asked for since, which changes no result.
    """

    def __init__(self, path: str, keep_blank: bool, width: str, most: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, size = self.tokenizer.model, np.dtype(width).itemsize
        if self.tokenizer.get_vocab_size() > 256**size:
            raise ValueError(f"ids of {path} need more than {size} bytes")
        self.code = {2: "H", 4: "I"}[size]
        self.keep_blank, self.most, self.bytes = keep_blank, most, _byte_letters()
        self.blank = chr(self.bytes[32])
        self.cut = _PATTERNS["byte" if keep_blank else "word"].findall
        self.known, self.older = {}, {}

    def forget(self) -> None:
        """Lets go of all pieces, for a task's end: a worker that Spark keeps for later tasks is then small."""
        self.known, self.older = {}, {}
        common.give_back_memory()

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _piece(self, piece: str | tuple[str]) -> bytes:
        """Ids of a piece; a tuple holds a unit that is not plain."""
        if isinstance(piece, tuple):
            return self._whole(piece[0])
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", self.blank)
        else:
            letters = piece.encode().decode("latin-1").translate(self.bytes)
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _pieces(self, text: str) -> list[str | tuple[str]] | None:
        """None for a text that only the whole tokenizer can cut."""
        if text.isascii() or not _ODD.search(text):
            return self.cut(text if self.keep_blank else text.lower())
        if self.keep_blank:
            doubled = "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in "\n\t\r\x0b\x0c")
            if doubled or _WIDE_SPACE.search(text):
                return None
        out: list[str | tuple[str]] = []
        for i, unit in enumerate(text.split(" ")):
            unit = " " + unit if self.keep_blank and i else unit
            if unit.isascii() or not _ODD.search(unit):
                out += self.cut(unit if self.keep_blank else unit.lower())
            else:
                out.append((unit,))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian integers of `width`; null counts as empty."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for t in texts:
            pieces = self._pieces(t) if t else []
            if pieces is None:
                out.append(self._whole(t))
                continue
            found = list(map(known.get, pieces))
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        p = pieces[k]
                        ids = known.get(p)
                        if ids is None:
                            ids = older.get(p)
                            known[p] = ids = self._piece(p) if ids is None else ids
                        found[k] = ids
            out.append(b"".join(found))
        return out


def encoder(path: str, keep_blank: bool, width: str) -> UnitEncoder:
    """One for each worker process; the file is read once."""
    key = (path, keep_blank, width)
    if key not in _LOADED:
        _LOADED[key] = UnitEncoder(path, keep_blank, width)
    return _LOADED[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def in_slices(texts: list[str | None], chars: int = 4_000_000):
    """Runs of texts of at most about `chars` characters, so that a batch of long documents stays small in memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
