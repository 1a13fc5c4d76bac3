"""Positions in UTF-8 bytes and in code points, by an index of the exceptions alone."""

from __future__ import annotations

import numpy as np


class Offsets:
    """Where a text's multibyte characters stand and how many bytes each has beyond one.

    A text of ASCII alone has an empty index and its positions are equal on both sides. Elsewhere a position is moved by
    the excess bytes of the characters before it, found by one binary search, so the index is as large as the number of
    exceptions and spans of ASCII cost nothing.
    """

    def __init__(self, raw: np.ndarray):
        """raw: the text's UTF-8 as uint8."""
        high = np.flatnonzero(raw >= 0xC0)  # first bytes of multibyte characters
        lead = raw[high]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(extra)))
        self.byte_at = high
        self.char_at = high - self.excess[:-1]
        self.size = len(raw)

    def __len__(self) -> int:
        """Code points of the text."""
        return self.size - int(self.excess[-1])

    def to_bytes(self, chars):
        """Byte positions of code point positions; numbers or arrays."""
        return chars + self.excess[np.searchsorted(self.char_at, chars)]

    def to_chars(self, at):
        """Code point positions of byte positions that begin a character or end the text; numbers or arrays."""
        return at - self.excess[np.searchsorted(self.byte_at, at)]
