"""Words of many texts at once, in numpy: their places, 64-bit hashes and character classes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_TABLES = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}
LOWER, UPPER, DIGIT, SIGN = 1, 2, 4, 8


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _TABLES["n"] < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.ones(size, np.uint64)
            table[1] = base
            have = 2
            while have < size:
                step = np.uint64(int(table[have - 1]) * base % (1 << 64))
                table[have : 2 * have] = table[: min(have, size - have)] * step
                have *= 2
            _TABLES[name] = table
        _TABLES["n"] = size
    return _TABLES["up"], _TABLES["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _classes() -> np.ndarray:
    """Class bits of the code points below 0x3000; signs also set a bit that depends on the sign."""
    out = np.zeros(0x3000, np.uint32)
    for c in range(0x3000):
        x = chr(c)
        if x.isalpha():
            out[c] = UPPER if x.isupper() else LOWER
        elif x.isdigit():
            out[c] = DIGIT
        elif not x.isspace():
            out[c] = SIGN | 1 << (4 + c % 28)
    return out


CLASSES = _classes()


class Words(NamedTuple):
    """Words of a chunk: start and end in the chunk's code points, hash; first and at: of each text, its first word and its place."""

    texts: list[str]
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.code) + 1)
        sums = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * up[: len(self.code)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def classes(self) -> np.ndarray:
        """For each word, the class bits of its characters together."""
        if not len(self.start):
            return np.zeros(0, np.uint32)
        bits = np.where(self.code < 0x3000, CLASSES[np.minimum(self.code, 0x2FFF)], np.uint32(LOWER))
        return np.bitwise_or.reduceat(bits, self.start)


def scan(texts: list[str], chunk: int = 1 << 16) -> Iterator[Words]:
    """Words (runs of other than ASCII white space) of whole texts, in chunks of about as many characters."""
    part, size = [], 0
    for i, text in enumerate(texts):
        part.append(text)
        size += len(text) + 1
        if size >= chunk or i == len(texts) - 1:
            code = np.frombuffer(("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            solid = ~((code == 32) | ((code >= 9) & (code <= 13)))
            edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
            edge = np.concatenate([[0], edge]) if solid[0] else edge
            start, end = edge[::2], edge[1::2]
            at = np.cumsum([0] + [len(x) + 1 for x in part])
            yield Words(part, code, start, end, np.searchsorted(start, at), at)
            part, size = [], 0
