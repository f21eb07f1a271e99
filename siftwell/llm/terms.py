"""Terms of texts, taken inside Python workers: maximal runs of wanted bytes of the UTF-8 form, A-Z lower-cased.

Every code point beyond ASCII belongs to a term, so a pattern over code points and one over bytes agree.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER, UPPER


def term_table(ascii_kept: str) -> bytes:
    """A ``bytes.translate`` table: letters to lower case, other wanted and all non-ASCII bytes as they are, the rest to blanks."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in ascii_kept + LOWER:
        table[ord(c)] = ord(c)
    for upper, lower in zip(UPPER, LOWER):
        table[ord(upper)] = ord(lower)
    return bytes(table)


LETTERS = term_table("")
LETTERS_AND_DIGITS = term_table("0123456789")


def split_terms(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode().translate(table).split()


class Numbers:
    """Numbers for terms, given in the order they come."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, terms: list[bytes]) -> np.ndarray:
        for term in set(terms).difference(self.known):
            self.known[term] = len(self.known)
        return np.fromiter(map(self.known.__getitem__, terms), dtype=np.int64, count=len(terms))
