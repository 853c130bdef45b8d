"""Pre-token splitting with a bounded cache of what each pre-token and segment yields."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import regex


# Fixed value: the split pattern of the byte-level vocabularies.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SegmentCache:
    """Maps texts to values of their pre-tokens, computing each distinct pre-token once.

    The pattern ``SPACED`` allows two shortcuts; texts under any other are split by it whole.
    A cut before a space that follows a non-space never lies inside a match of it: a
    space only ever starts a match or belongs to a run of white space. So ``text.split(" ")`` gives segments whose matches, each with its space
    put back, are those of the whole text. A text with two adjacent spaces is split
    by the pattern itself, since a run of spaces is then one match. A segment of
    letters, with or without ASCII marks behind, needs no pattern at all.

    ``compute`` gets new pre-tokens and returns a value for each, ``combine`` joins the
    values of a segment. The caches are emptied between groups of texts when they hold
    over ``max_chars`` (about 8 bytes of memory each).
    """

    def __init__(self, pattern: str, compute: Callable[[list[str]], Iterable[Any]], combine: Callable[[list[Any]], Any], max_chars: int = 6_000_000):
        self.find = regex.compile(pattern).findall
        self.spaced = pattern == SPACED
        self.compute = compute
        self.combine = combine
        self.max_chars = max_chars
        self.pieces: dict[str, Any] = {}
        self.after_space: dict[str, Any] = {}
        self.whole: dict[str, Any] = {}
        self.held = 0

    def _split(self, segment: str) -> list[str]:
        if not self.spaced:
            return [segment]
        word = segment[1:] if segment[:1] == " " else segment
        bare = word.rstrip(MARKS)
        if bare.isalpha():
            at = len(segment) - len(word) + len(bare)
            return [segment[:at], segment[at:]] if at < len(segment) else [segment]
        return self.find(segment)

    def _fill(self, missing: dict[str, None], lead: str, known: dict[str, Any]) -> None:
        pieces, split = self.pieces, {k: self._split(lead + k) for k in missing}
        new = list(dict.fromkeys(p for parts in split.values() for p in parts if p not in pieces))
        pieces.update(zip(new, self.compute(new), strict=True))
        for key, parts in split.items():
            known[key] = pieces[parts[0]] if len(parts) == 1 else self.combine([pieces[p] for p in parts])
            self.held += len(key) + 20

    def values(self, texts: Iterable[str], group_chars: int = 500_000) -> Iterator[list[Any]]:
        """For each text the values of its segments, in order."""
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= group_chars:
                yield from self._of(group)
                group, chars = [], 0
        yield from self._of(group)

    def _of(self, group: list[str]) -> list[list[Any]]:
        if self.held > self.max_chars:
            for cache in (self.pieces, self.after_space, self.whole):
                cache.clear()
            self.held = 0
        out: list[list[Any]] = []
        for lead, known in (("", self.whole), (" ", self.after_space)):
            get, late, missing = known.get, [], {}
            for row, text in enumerate(group):
                double = not self.spaced or "  " in text
                if not lead:
                    keys = self.find(text) if double else [text.partition(" ")[0]]
                    keys = keys if keys != [""] else []
                else:
                    keys = [] if double else text.split(" ")[1:]
                got = list(map(get, keys))
                if lead:
                    out[row] += got
                else:
                    out.append(got)
                if None in got:
                    start = len(out[row]) - len(got)
                    for at, (key, value) in enumerate(zip(keys, got, strict=True), start):
                        if value is None:
                            missing[key] = None
                            late.append((row, at, key))
            if missing:
                self._fill(missing, lead, known)
            for row, at, key in late:
                out[row][at] = known[key]
        return out


#: ASCII characters that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def without_gc(run: Callable[[], Any]) -> Any:
    """The cyclic collector only rescans the large caches here; nothing made is cyclic."""
    gc.disable()
    try:
        return run()
    finally:
        gc.enable()


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


BYTE_TO_CHAR = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
CHAR_TO_BYTE = {c: b for b, c in enumerate(byte_alphabet())}


def mapped(pieces: list[str]) -> list[str]:
    """Each piece's UTF-8 bytes, one printable character each."""
    joined = "\0".join(pieces)
    if joined.count("\0") >= len(pieces):
        return [p.encode("utf-8").decode("latin-1").translate(BYTE_TO_CHAR) for p in pieces]
    return joined.encode("utf-8").decode("latin-1").translate(BYTE_TO_CHAR).split(BYTE_TO_CHAR[0]) if pieces else []
