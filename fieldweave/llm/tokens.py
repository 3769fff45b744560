"""Whole-text token ids with the `tokenizers` library, through a bounded cache of text units.

Pre-tokenizers never join text across certain white space, so a text is cut there into units, each
distinct unit is encoded once, and ids are joined. Ids equal `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes that a worker keeps of units, and of their pieces, at most; beyond them a cache starts afresh, which changes no result.
CACHE_BYTES = 150_000_000
#: What an entry takes besides its text and its ids.
_ENTRY = 210

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Units without such characters (a space in front aside) are cut by the rules below; all others go through the whole tokenizer.
_NOT_PLAIN = re.compile(f"[^{_LETTERS}!-&(-~]")
_PIECES = {
    "byte": re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s"),
    "word": re.compile(f"[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+"),
}
#: Where none of these occurs, spaces and newlines are the only white space and stand alone.
_ODD_SPACES = ("  ", "\n\n", " \n", "\n ", "\0", *[chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n"])
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


_ALPHABET = byte_alphabet()


class _Units(dict):
    """unit -> ids; a unit not seen before is encoded on first use."""

    def __init__(self, make):
        super().__init__()
        self.make, self.bytes = make, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        self.bytes += _ENTRY + 2 * len(key) + len(ids)
        if self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = 0
        self[key] = ids
        return ids


class UnitEncoder:
    """kind 'byte': byte-level BPE that keeps spaces; kind 'word': lower-casing BPE that drops white space."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind, self.tokenizer = kind, Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.spelled = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.find = _PIECES[kind].findall
        self.cache, self.pieces = _Units(self._unit), _Units(self._piece)

    def split(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _ODD_SPACES)):
            parts = _SINGLE_SPACE.split(text)
            return parts[:1] + [" " + p for p in parts[1:]]
        # White space stands alone everywhere: a space joins what follows, a newline is a unit of its own.
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():  # of these, only white space has a stand-in
            found = self.tokenize(piece.replace(" ", "Ġ").replace("\n", "Ċ"))
        else:
            found = self.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))
        spelled = self.spelled
        return b"".join([spelled[t.id] for t in found])

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if _NOT_PLAIN.search(unit, unit[0] == " ") or "<|" in unit:
            return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()
        found = self.find(unit if self.kind == "byte" else unit.lower())
        pieces = self.pieces
        return pieces[found[0]] if len(found) == 1 else b"".join([pieces[p] for p in found])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, self.split(text)))


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, kind: str) -> UnitEncoder:
    """One encoder a worker, whose cache lasts from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = UnitEncoder(path, kind)
    return _ENCODERS[path, kind]
