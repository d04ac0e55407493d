"""Shared pieces for turning texts into arrays of numbers, many texts at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np

MAX_CACHED = 400_000
CHUNK_BYTES = 1 << 20


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (space, tab, line feed, VT, form feed, CR)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class CodeCache(dict):
    """Word -> number by a rule, remembered; forgets everything when it has grown too large."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, word):
        if len(self) >= MAX_CACHED:
            self.clear()
        value = self[word] = self.rule(word)
        return value


def chunks(texts: Iterable[str | None], size: int = CHUNK_BYTES) -> Iterator[list[str | None]]:
    """Consecutive texts, about ``size`` characters at a time; texts stay whole."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def word_codes(texts: list[str | None], cache: CodeCache) -> tuple[np.ndarray, np.ndarray]:
    """The code of every word of the texts, and the number of the text it belongs to."""
    every, counts = [], []
    for t in texts:
        w = words(t)
        every += w
        counts.append(len(w))
    codes = np.fromiter(map(cache.__getitem__, every), np.uint64, len(every))
    return codes, np.repeat(np.arange(len(texts)), counts)


def crc(part: bytes) -> int:
    return zlib.crc32(part)


def spread(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Hashes to feature indices below 2 ** bits."""
    h = (h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ b


def gap_pairs(h: np.ndarray, row: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words ``gap`` apart in the same text, and their texts."""
    same = row[gap:] == row[:-gap]
    return pair(h[:-gap][same], h[gap:][same]), row[gap:][same]
