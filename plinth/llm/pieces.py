"""Cutting texts into the pieces that a word BPE tokenizer encodes on their own.

The tokenizer composes (NFC), folds white space and lower-cases a text, then
takes contractions, runs of letters, single numbers and runs of the rest as
words, and encodes each by itself. So equal pieces have equal ids wherever they
stand, and a cache of pieces (emptied when full) spares most of the work. The
cache is bounded by entries and by bytes, and takes no piece longer than
LONGEST.

Texts of Latin-1 characters are cut by one expression. Of other texts, the
stretches between ASCII white space that hold other characters, and stretches
that hold a special token, are pieces as they are, left to the encoder whole.
This holds for tokenizer files that normalise and split as NORMALIZER and SPLIT
say (``cuts_like``); a text for any other file is one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CACHE = 400_000
CACHE_BYTES = 96 << 20
LONGEST = 64
#: What an entry takes beside its characters and ids.
_ENTRY = 200

# The normaliser and the splitter that the expressions below stand for, as the tokenizer file writes them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r\x0b\x0c\x85\xa0{_LETTERS}{_NUMBERS}]+")
_STRETCHES = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_SPECIAL = "<|"


def is_plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return _SPECIAL not in text


def pieces(text: str) -> list[str]:
    """The text's pieces in order."""
    if is_plain(text):
        return _WORDS.findall(text.lower())
    out = []
    for stretch in _STRETCHES.findall(text):
        out.extend(_WORDS.findall(stretch.lower()) if is_plain(stretch) else [stretch])
    return out


def _byte_names() -> dict[int, int]:
    """Byte to the code point that stands for it: itself if it prints, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_BYTES = _byte_names()


def byte_level(piece: str) -> str:
    """A plain piece as the byte-level vocabulary writes it."""
    return piece.encode().decode("latin-1").translate(_BYTES)


def cuts_like(spec: dict) -> bool:
    """Whether the tokenizer file ``spec`` normalises, splits and takes special tokens as ``pieces`` does."""
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    tokens = all(t["content"].startswith(_SPECIAL) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    return model["type"] == "BPE" and plain and tokens and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER


class PieceIds(dict):
    """Piece to ids (little-endian 32-bit, as bytes), by an encoder of single pieces; ``cut`` makes a text's pieces."""

    def __init__(self, encode: Callable[[str], bytes], cut: Callable[[str], list[str]] = pieces):
        super().__init__()
        self._encode, self._cut, self._bytes = encode, cut, 0

    def __missing__(self, piece: str) -> bytes:
        found = self._encode(piece)
        if len(piece) <= LONGEST:
            self._bytes += _ENTRY + 4 * len(piece) + len(found)
            if len(self) >= CACHE or self._bytes > CACHE_BYTES:
                self.clear()
                self._bytes = 0
            self[piece] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """All ids of a text (null: none)."""
        return b"".join(map(self.__getitem__, self._cut(text))) if text else b""
