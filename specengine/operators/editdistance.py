"""Edit distances of a text to many lines at once, by whole-number bit operations.

The columns of the distance table are kept as bits (Myers 1999, Hyyrö 2003):
two bits per letter tell whether the table rises or falls there.  The lines lie
one after another in one large whole number, with free bits between them that
stop carries, so one operation works on all letters of all lines.
"""

from __future__ import annotations

import numpy as np


class PackedLines:
    """A queue of lines: `add` puts one behind the others, `drop` takes off the first, `distances` compares all."""

    def __init__(self):
        self.where: dict[str, int] = {}
        self.letters = self.starts = 0
        self.sizes: list[int] = []

    def add(self, line: str) -> None:
        shift = 8 * sum(self.sizes)
        size = len(line) // 8 + 1  # whole bytes, with a free bit at least
        places: dict[str, list[int]] = {}
        for i, letter in enumerate(line):
            places.setdefault(letter, []).append(i)
        for letter, at in places.items():
            bits = np.zeros(8 * size, np.uint8)
            bits[at] = 1
            packed = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            self.where[letter] = self.where.get(letter, 0) | packed << shift
        self.letters |= ((1 << len(line)) - 1) << shift
        self.starts |= (1 if line else 0) << shift
        self.sizes.append(size)

    def drop(self) -> None:
        bits = 8 * self.sizes.pop(0)
        self.where = {letter: left for letter, packed in self.where.items() if (left := packed >> bits)}
        self.letters >>= bits
        self.starts >>= bits

    def distances(self, text: str) -> np.ndarray:
        """Insertions, deletions and replacements between the text and each line."""
        every, starts, where = self.letters, self.starts, self.where
        rises, falls = every, 0
        for letter in text:
            equal = where.get(letter, 0)
            across = (((equal & rises) + rises) ^ rises) | equal
            level = equal | falls
            kept = across | rises
            up = (((every | kept) ^ kept) | falls) << 1 | starts
            down = (rises & across) << 1
            kept = level | up
            rises = (down | ((every | kept) ^ kept)) & every
            falls = up & level
        n = sum(self.sizes)
        begin = np.cumsum([0, *self.sizes[:-1]])
        count = [np.add.reduceat(np.bitwise_count(np.frombuffer(x.to_bytes(n, "little"), np.uint8)).astype(np.int64), begin)
                 for x in (rises, falls)]
        return len(text) + count[0] - count[1]
