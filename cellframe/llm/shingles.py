"""Word shingles as 64-bit hashes, computed over whole groups of texts at once.

Words are runs of characters other than space and U+0009 to U+000D, with A-Z
lower-cased; a text's set are its distinct five-word shingles. A text of fewer words has
its whole sequence as the only one, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words up to each text's end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    letters = _LOWER[data[~space]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(letters)) - np.repeat(offsets, lengths)
    hashes = np.add.reduceat(letters * _powers(_BASE, int(lengths.max()))[place], offsets)
    return mixed(hashes + lengths.astype(np.uint64) * _STEP), np.searchsorted(starts, np.cumsum(sizes + 1))


def of_words(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    powers = _powers(_STEP, n + 1)
    total = np.full(count, n * int(_BASE) % (1 << 64), np.uint64)
    for k in range(n):
        total += words[k : k + count] * powers[k + 1]
    return mixed(total)


def per_text(texts: Iterable[str | None], group_bytes: int = 1_000_000) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    group: list[bytes] = []
    size = 0

    def of(group: list[bytes]) -> Iterator[np.ndarray]:
        hashes, ends = word_hashes(group)
        begin = 0
        for end in ends.tolist():
            yield hashes[begin:end]
            begin = end

    for text in texts:
        raw = (text or "").encode("utf-8")
        group.append(raw)
        size += len(raw)
        if size >= group_bytes:
            yield from of(group)
            group, size = [], 0
    if group:
        yield from of(group)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words."""
    return np.unique(of_words(words, min(WORDS, len(words)))) if len(words) else words


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    return map(shingle_set, per_text(texts))
