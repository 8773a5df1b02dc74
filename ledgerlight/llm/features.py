"""Sparse indicators of a text: n-grams of its words, of their shapes and, if asked for, of their first letters, hashed to 32 bits.

A shape keeps the kinds of characters alone: runs of small letters, of capitals and of digits shrink to one sign each, and
runs of one other sign to that sign. Texts are taken whole, in batches, with array operations; a worker
remembers the hashes of words.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np

REMEMBERED = 200_000
#: Odd factors that mix the hashes of neighbours; the last three tell the kinds of n-grams apart.
LEFT, RIGHT, SHAPED, DOUBLED, TRIPLED = 2654435761, 2246822519, 3266489917, 668265263, 374761393
REPEATED = 1
MASK = (1 << 32) - 1

_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^\w]|_)\1+"))


def shape(word: str) -> str:
    letters = _RUNS[0].sub(lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa" if m[0][:1].isupper() else "aA", word)
    return _RUNS[2].sub(r"\1", _RUNS[1].sub("9", letters))


#: Lengths of the first letters of a word that make features; shorter words have 0 there.
HEADS = (5, 7)


class Words(dict):
    """A word's bytes to its column in an array of hashes: of the word, A-Z lower-cased, of its shape and, if asked for, of its heads."""

    def __init__(self, heads: tuple[int, ...]) -> None:
        super().__init__()
        self.room, self.heads = 1 << 16, heads
        self.hashes = np.zeros((2 + len(heads), self.room), np.uint64)

    def __missing__(self, raw: bytes) -> int:
        n = len(self)
        if n == self.room:
            self.room *= 2
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)), 1)
        word = raw.decode()
        self.hashes[0, n], self.hashes[1, n] = crc32(raw.lower()), crc32(shape(word).encode(), 7)
        if self.heads:
            small = word.lower()
            self.hashes[2:, n] = [crc32(small[:k].encode() + bytes((255, k))) if len(small) > k else 0 for k in self.heads]  # 255 is in no word
        self[raw] = n
        return n


@lru_cache(2)
def known(heads: tuple[int, ...]) -> Words:
    return Words(heads)


def mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a * np.uint64(LEFT) + b * np.uint64(RIGHT) + np.uint64(kind)) & np.uint64(MASK)
    x ^= x >> np.uint64(15)
    return x * np.uint64(kind) & np.uint64(MASK)


def indicators(texts: list[str | None], wanted: np.ndarray | None = None, heads: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, feature) pairs, distinct and sorted. ``wanted``: a bitmap of the low bits of features to keep."""
    words = known(HEADS if heads else ())
    if len(words) > REMEMBERED:
        words.clear()
    split = [(t or "").encode().split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    at = np.fromiter((words[w] for one in split for w in one), np.int64, int(lengths.sum()))
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    word, form = words.hashes[0][at], words.hashes[1][at]
    two, three = row[1:] == row[:-1], row[2:] == row[:-2]
    again = two & (word[1:] == word[:-1])
    pairs, forms = mixed(word[:-1], word[1:], DOUBLED), mixed(form[:-1], form[1:], SHAPED)
    parts = [
        (row, word),
        (row, mixed(form, form, SHAPED)),
        (row[1:][two], pairs[two]),
        (row[1:][two], forms[two]),
        (row[2:][three], mixed(forms[:-1], form[2:], TRIPLED)[three]) if len(form) > 2 else (row[:0], word[:0]),
        (row[1:][again], np.full(int(again.sum()), REPEATED, np.uint64)),
    ]
    for k in range(len(words.heads)):
        head = words.hashes[2 + k][at]
        parts.append((row[head > 0], head[head > 0]))
    keys = []
    for place, feature in parts:
        if wanted is not None:
            kept = wanted[(feature & np.uint64(len(wanted) - 1)).astype(np.int64)]
            place, feature = place[kept], feature[kept]
        keys.append(place << np.uint64(32) | feature)
    unique = np.unique(np.concatenate(keys))
    return (unique >> np.uint64(32)).astype(np.int64), (unique & np.uint64(MASK)).astype(np.uint32)


def blocks(texts, size: int = 200_000):
    """Cut an Arrow column of texts into lists of about ``size`` bytes, with the place of the first; a longer text is alone."""
    out, total, first = [], 0, 0
    for i in range(len(texts)):
        value = texts[i].as_py()
        n = len(value or "")
        if out and total + n > size:
            yield first, out
            out, total, first = [], 0, i
        out.append(value)
        total += n
    if out:
        yield first, out


class Linear:
    """Weights by feature, looked up by a bitmap first."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, heads: bool = False, bits: int = 22):
        order = np.argsort(features)
        self.features, self.weights, self.bias, self.heads, self.bits = features[order], weights[order], bias, heads, bits

    @property
    def wanted(self) -> np.ndarray:
        bitmap = np.zeros(1 << self.bits, bool)
        bitmap[self.features & np.uint32((1 << self.bits) - 1)] = True
        return bitmap

    def margins(self, texts: list[str | None], wanted: np.ndarray) -> np.ndarray:
        row, feature = indicators(texts, wanted, self.heads)
        if not len(self.features):
            return np.full(len(texts), self.bias)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        return self.bias + np.bincount(row[hit], self.weights[at[hit]], len(texts))
