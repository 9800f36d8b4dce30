"""Token ids of whole texts: the tokenizers library, asked once for each distinct piece."""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Callable
from functools import partial
from itertools import chain

#: How the two vocabularies cut text before merging (their own pre-tokenizers do the same), written out for
#: the characters of PLAIN. L stands for their letters.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[0-9]+| ?[^\sL0-9]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[0-9]|[^\sL0-9]+"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = rf"[\x00-\x7f{LETTERS}]*"
MARKS = frozenset(".,;:!?")
BIG_ENDIAN = sys.byteorder == "big"
#: Bytes of units and their ids that a Python worker remembers (with ENTRY for each), and an eighth of it for each of two
#: smaller stores. Units over LONG characters are not remembered.
MEMORY, ENTRY, LONG = 160 << 20, 200, 64


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text, read on the driver and sent with the tasks (2 to 4 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes a byte as a printable character: itself where it is one, else from 256 on, in order."""
    plain = set(chain(range(33, 127), range(161, 173), range(174, 256)))
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    if BIG_ENDIAN:
        return struct.pack(f"<{len(ids)}I", *ids)
    return array("I", ids).tobytes()


class _Odd(Exception):
    """A unit that must be seen with its neighbours."""


class _Units(dict):
    """Unit -> ids; a new one is computed when it is first asked for. Once half of the memory is full, what it holds
    becomes the old half, of which only the units asked for again stay."""

    def __init__(self, compute: Callable[[str], bytes], memory: int):
        super().__init__()
        self.compute, self.half, self.held, self.old = compute, memory // 2, 0, {}

    def __missing__(self, unit: str) -> bytes:
        got = self.old.pop(unit, None)
        if got is None:
            got = self.compute(unit)
        if len(unit) <= LONG:
            self.held += len(unit) + len(got) + ENTRY
            if self.held > self.half:
                self.old, self.held = self.copy(), 0
                self.clear()
            self[unit] = got
        return got


class Encoder:
    """Texts -> arrays of ids, equal to ``encode(text, add_special_tokens=False)`` of the library.

    A text is cut at single spaces, where both vocabularies cut too, into units; each unit is looked up, and a new one
    is cut into pieces by the vocabulary's pattern and merged by the library's model. The classes of characters beyond
    PLAIN are the library's own affair: a unit with such characters is encoded by it, and a text that may hold a special
    token as a whole.
    """

    def __init__(self, spec: str, memory: int | None = None):
        from tokenizers import Tokenizer

        memory = memory or MEMORY

        self.whole = Tokenizer.from_str(spec)
        self.tokenize = self.whole.model.tokenize
        self.spaced = self.whole.normalizer is None  # a unit after the first begins with its space
        self.pieces = re.compile((BYTE_PIECES if self.spaced else WORD_PIECES).replace("L", LETTERS), re.ASCII).findall
        self.odd = re.compile(r"<\|" if self.spaced else r"<\||[\x00-\x08\x0b\x0c\x0e-\x1f\x85\u2028\u2029]").search
        self.letters, self.plain = re.compile(f"[{LETTERS}]+").fullmatch, re.compile(PLAIN).fullmatch
        self.alphabet = _byte_alphabet()
        self.firsts = _Units(partial(self._unit, lead=""), memory // 8 if self.spaced else memory)
        self.units = _Units(partial(self._unit, lead=" "), memory) if self.spaced else self.firsts
        self.parts = _Units(self._merge, memory // 8)

    def _merge(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            return _packed([t.id for t in self.tokenize(piece.replace(" ", "\u0120"))])
        return _packed([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))])

    def _unit(self, unit: str, lead: str) -> bytes:
        """``lead`` is the space before the unit where the vocabulary keeps it. Letters, then one mark, is the common
        case: its letters are a unit of their own."""
        if unit.isascii():
            if unit.isalpha():
                word = unit if self.spaced else unit.lower()
                return _packed([t.id for t in self.tokenize("\u0120" + word if lead else word)])
            plain = True
        elif self.letters(unit):
            return self._merge(lead + (unit if self.spaced else unit.lower()))
        else:
            plain = self.plain(unit)
        if unit[-1:] in MARKS and self.letters(unit[:-1]):
            return (self.units if lead else self.firsts)[unit[:-1]] + self.parts[unit[-1]]
        if self.odd(unit):
            raise _Odd
        if not plain:
            return self._whole(lead + unit)
        return b"".join(map(self.parts.__getitem__, self.pieces(lead + (unit if self.spaced else unit.lower()))))

    def _whole(self, text: str) -> bytes:
        return _packed(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; null and empty texts have none."""
        if not text:
            return b""
        units = (text if self.spaced else text.replace("\n", " ")).split(" ")
        try:
            return self.firsts[units[0]] + b"".join(map(self.units.__getitem__, units[1:]))
        except _Odd:
            return self._whole(text)


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str, memory: int | None = None) -> Encoder:
    """The worker's encoder for a tokenizer; kept between tasks."""
    k = hash((spec, memory))
    if k not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[k] = Encoder(spec, memory)
    return _ENCODERS[k]

