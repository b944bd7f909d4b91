"""Byte-level BPE ids of texts, from the file of a public tokenizer."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import tiktoken

# Fixed value: the split pattern of this kind of tokenizer, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts whose white space never comes in runs.
PLAIN_PATTERN = PATTERN.replace(r"\s+(?!\S)|", "")

_BLANK_TABLE = bytes(0x20 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
# What begins or is the UTF-8 of white space outside ASCII.
_OTHER_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte strings and their ids. The file writes bytes as characters: printable ones as they are,
    the others as those from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model.get("added_tokens", [])}
    return {
        bytes(byte_of[c] for c in piece): number
        for piece, number in model["model"]["vocab"].items()
        if piece not in special
    }


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; strings of special tokens are ordinary text.

    Looking ahead is only needed where white space runs on for two characters or more. Texts
    without such a run are split by the plain pattern, which takes a faster matcher to the same
    pieces.
    """

    def __init__(self, path: str):
        ranks = vocabulary(path)
        self._full, self._plain = (
            tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for p in (PATTERN, PLAIN_PATTERN)
        )

    def encode(self, text: bytes) -> bytes:
        """The ids of a text; invalid UTF-8 is read as replacement characters."""
        runs = b"  " in text.translate(_BLANK_TABLE) or any(x in text for x in _OTHER_SPACES)
        ids = (self._full if runs else self._plain)(text.decode("utf-8", "replace"))
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path)
