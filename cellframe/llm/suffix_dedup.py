"""Removal of repeated 50-byte strings by prefix-free parsing, on two levels.

Across the corpus, a rolling hash over 24 bytes triggers phrase ends: of the 27 places of a
50-byte string the one with the least hash (leftmost among equals) is its trigger, so all
occurrences of the string, in whatever document, hang on the same trigger. The strings that
start in one stretch and share a trigger make a phrase, which carries the 49 bytes that
follow its last start. A chunk of documents has a dictionary (distinct phrases, each with
its least document id) and a parse (which phrase every document has where).

Buckets, by trigger string, merge the dictionaries in three steps: triggers that one
phrase alone has are done; phrases equal everywhere need only their least document id;
where different phrases share a trigger, they are the text of a second prefix-free
parsing (``corpus_order``): its rolling hash cuts them into short phrases, the suffix array
of the dictionary of those and the suffix array of their parse are combined into the order
of all strings, and runs of strings with equal bytes give each string's least document id.
Chunks read the answers back through their parse, so a passage in a third of all documents,
with equal surroundings, costs a bucket one entry for each chunk. With different surroundings
it gives as many phrases as documents at its ends: a trigger with a ``SHARE`` of its bucket's
entries is hot, and its 50-byte strings are dealt to all buckets by hashes of their own, where equal
ones meet.

Whole phrases are equal if their 64-bit hashes are (within one 24-byte trigger string, and
short phrases within one batch), strings of hot triggers if their 128-bit hashes are; strings of
other phrases are compared as bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm import chunks as ck
from cellframe.llm.shingles import mixed

LENGTH = 50
SEED = 24
PLACES = LENGTH - SEED + 1
SEGMENT = 1 << 16
ALONE, SAME, MIXED, HOT = 0, 1, 2, 3
#: Entries of a trigger, over all chunks, and share of its bucket's, beyond which its strings are dealt out.
CROWD, SHARE = 256, 1 / 16
#: Window and mean length of the short phrases, and bytes of text ordered at a time.
SHORT_WINDOW, SHORT_EVERY, BATCH = 6, 8, 1_000_000
_WORDS = (0, 8, 16, 24, 32, 40, LENGTH - 8)
_ALL = np.uint32((1 << 32) - 1)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_BASE = 0x5851F42D4C957F2D
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT + LENGTH, _BASE, np.uint64)]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8-byte little-endian word at every place."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """The polynomial hash, modulo 2^64, of the window at every place of up to a segment.

    It rolls as differences of running sums: what leaves is taken off, what enters added,
    and the power of the place divided out.
    """
    terms = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    places = max(len(data) - window + 1, 0)
    return mixed((sums[window:] - sums[:places]) * _INVERSES[:places])


# --- phrases of a chunk ---


class Parse:
    """A chunk's documents as phrases, and its dictionary in a fixed order."""

    def __init__(self, table: pa.Table, buckets: int):
        self.ids = table.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8") for t in table.column("text").to_pylist()]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        known = np.array([i is not None for i in self.ids], bool)
        #: Strings start before this place of each row.
        behind = np.where(known, self.ends - LENGTH + 1, 0)
        seed, place = self._cut(behind)
        following = np.append(self.first[1:], len(self.data))
        last_of_row = np.append(self.row[1:] != self.row[:-1], True) if len(self.row) else np.zeros(0, bool)
        self.many = np.where(last_of_row, behind[self.row], following[: len(self.row)]) - self.first
        lead = (place - self.first).astype(np.uint64)
        last = self.first + self.many - 1
        words = words_at(self.data)
        phrase = self.many.astype(np.uint64) * _K[5] + lead * _K[6]
        for k, offset in enumerate(_WORDS):
            phrase = phrase + words[self.first + offset] * _K[k]
            phrase = mixed(phrase + words[last + offset] * _K[6 - k])
        doc = np.array([i if i is not None else 0 for i in self.ids], np.int64)[self.row]
        bucket = ck.bucket_of(seed, buckets)
        order = np.lexsort((doc, phrase, seed & np.uint64((1 << 40) - 1), bucket))
        seed, phrase, bucket = seed[order], phrase[order], bucket[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (seed[1:] != seed[:-1]) | (phrase[1:] != phrase[:-1])
        #: The dictionary: trigger hash, phrase hash, least document id, a phrase in place that shows it.
        self.seed, self.phrase, self.shown = seed[fresh], phrase[fresh], order[fresh]
        self.least = doc[self.shown]
        self.doc = doc
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.starts = np.searchsorted(bucket[fresh], np.arange(buckets + 1))

    def _cut(self, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets first start and row of each phrase in place; (trigger hash, trigger place) of each."""
        firsts, rows, seeds, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        starts = max(len(self.data) - LENGTH + 1, 0)
        low = np.uint64(SEGMENT * 2 - 1)
        place_before, row_before = -1, -1
        for begin in range(0, starts, SEGMENT):
            end = min(begin + SEGMENT, starts)
            h = rolling(self.data[begin : end + LENGTH - 1], SEED)
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            for step in (1, 2, 4, 8, PLACES - 16):
                key = np.minimum(key[:-step], key[step:])
            at = (key & low).astype(np.int64)
            row = np.searchsorted(self.ends, np.arange(begin, end), side="right")
            place = at + begin
            edge = np.flatnonzero(((np.diff(place, prepend=place_before) != 0) | (np.diff(row, prepend=row_before) != 0)) & (np.arange(begin, end) < behind[row]))
            firsts.append(edge + begin)
            rows.append(row[edge])
            seeds.append(h[at[edge]])
            places.append(place[edge])
            place_before, row_before = int(place[-1]), int(row[-1])
        self.first, self.row = np.concatenate(firsts), np.concatenate(rows)
        return np.concatenate(seeds), np.concatenate(places)

    def ranges(self) -> Iterator[tuple[int, slice]]:
        for b in np.flatnonzero(np.diff(self.starts)).tolist():
            yield b, slice(self.starts[b], self.starts[b + 1])

    def names(self) -> Iterator[tuple[int, bytes]]:
        """First question: the name of each entry's trigger and the hash of its phrase."""
        for b, own in self.ranges():
            yield b, ck.pack40(self.seed[own]) + self.phrase[own].astype("<u8").tobytes()

    def kinds(self, replies: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.seed), np.uint8)
        for b, own in self.ranges():
            out[own] = np.frombuffer(replies[b], np.uint8)
        return out

    def content(self, entries: np.ndarray) -> bytes:
        """The bytes of phrases, one behind the other."""
        at = self.shown[entries]
        size = self.many[at] + LENGTH - 1
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.data[np.repeat(self.first[at], size) + offset].tobytes()

    def hot(self, kinds: np.ndarray) -> HotStrings:
        """The strings of the phrases whose triggers are hot."""
        entries = np.flatnonzero(kinds == HOT)
        many = self.many[self.shown[entries]]
        entry = np.repeat(entries, many)
        start = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
        words, at = words_at(self.data), self.first[self.shown[entry]] + start
        names = np.zeros((2, len(entry)), np.uint64)
        for k, offset in enumerate(_WORDS if len(entry) else ()):
            names[0] = mixed(names[0] + words[at + offset] * _K[k])
            names[1] = mixed(names[1] * _K[6 - k] + words[at + offset])
        return HotStrings(entry, start, names, self.least[entry], len(self.starts) - 1)

    def details(self, replies: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        """Second question: hashes of the phrases that are equal everywhere, bytes of the others, hashes of hot triggers' strings."""
        kinds = self.kinds(replies)
        hot, ranges = self.hot(kinds), dict(self.ranges())
        for b in sorted({*ranges, *hot.buckets()}):
            own, dealt = ranges.get(b, slice(0, 0)), hot.of(b)
            same = np.flatnonzero(kinds[own] == SAME) + own.start
            mixed_up = np.flatnonzero(kinds[own] == MIXED) + own.start
            if len(same) or len(mixed_up) or dealt.stop > dealt.start:
                body = [struct.pack("<III", len(same), len(mixed_up), dealt.stop - dealt.start), self.phrase[same].tobytes(), self.least[same].tobytes()]
                body += [hot.first[dealt].tobytes(), hot.second[dealt].tobytes(), hot.least[dealt].tobytes()]
                body += [self.least[mixed_up].tobytes(), self.many[self.shown[mixed_up]].astype(np.uint8).tobytes(), ck.pack40(self.seed[mixed_up]), self.content(mixed_up)]
                yield b, b"".join(body)

    def removed(self, first: dict[int, bytes], second: dict[int, bytes]) -> np.ndarray:
        """Whether each byte of the chunk is covered by a string that an earlier document has."""
        kinds = self.kinds(first)
        earlier = np.zeros(len(self.seed), np.uint32)
        hot, ranges = self.hot(kinds), dict(self.ranges())
        before = np.zeros(len(hot.first), bool)
        for b, reply in second.items():
            own, dealt = ranges.get(b, slice(0, 0)), hot.of(b)
            same = np.flatnonzero(kinds[own] == SAME) + own.start
            mixed_up = np.flatnonzero(kinds[own] == MIXED) + own.start
            least = np.frombuffer(reply, np.int64, len(same))
            earlier[same] = np.where(least < self.least[same], _ALL, np.uint32(0))
            earlier[mixed_up] = np.frombuffer(reply, "<u4", len(mixed_up), 8 * len(same))
            before[dealt] = np.frombuffer(reply, np.uint8, offset=8 * len(same) + 4 * len(mixed_up)) > 0
        if len(hot.entry):
            earlier |= hot.masks(before, self.least, len(self.seed), self.many[self.shown])
        mask = np.where(self.doc > self.least[self.entry], _ALL, earlier[self.entry])
        whole = mask == _ALL
        step = np.bincount(self.first[whole], minlength=len(self.data) + LENGTH + 1).astype(np.int32)
        step -= np.bincount(self.first[whole] + self.many[whole] + LENGTH - 1, minlength=len(step)).astype(np.int32)
        part = np.flatnonzero((mask != 0) & ~whole)
        number = self.many[part]
        offset = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        starts = (np.repeat(self.first[part], number) + offset)[(np.repeat(mask[part], number) >> offset.astype(np.uint32)) & np.uint32(1) == 1]
        step[starts] += 1
        step[starts + LENGTH] -= 1
        return np.cumsum(step, dtype=np.int32)[: len(self.data)] > 0


class HotStrings:
    """The distinct strings of a chunk's hot phrases, dealt to buckets by their own hashes, each with its least document id."""

    def __init__(self, entry: np.ndarray, start: np.ndarray, names: np.ndarray, least: np.ndarray, buckets: int):
        self.entry, self.start = entry, start
        bucket = ck.bucket_of(names[0], buckets)
        order = np.lexsort((least, names[1], names[0], bucket))
        first, second = names[0][order], names[1][order]
        fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(order)]
        self.first, self.second, self.least = first[fresh], second[fresh], least[order][fresh]
        #: Which of them each (entry, start) is.
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.starts = np.searchsorted(bucket[order][fresh], np.arange(buckets + 1))

    def buckets(self) -> list[int]:
        return np.flatnonzero(np.diff(self.starts)).tolist()

    def of(self, bucket: int) -> slice:
        return slice(int(self.starts[bucket]), int(self.starts[bucket + 1]))

    def masks(self, before: np.ndarray, least: np.ndarray, entries: int, many: np.ndarray) -> np.ndarray:
        """For each entry a bit mask of its starts whose string an earlier document has, in another chunk or in this one."""
        hit = before[self.number] | (self.least[self.number] < least[self.entry])
        masks = np.zeros(entries, np.uint32)
        np.bitwise_or.at(masks, self.entry[hit], np.uint32(1) << self.start[hit].astype(np.uint32))
        return whole_masks(masks, many)


def whole_masks(masks: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The masks, those that have all of their starts as ``_ALL``."""
    return np.where(masks == (np.uint64(1) << many.astype(np.uint64)) - np.uint64(1), _ALL, masks).astype(np.uint32)


# --- buckets ---


def name_answer(payloads: list[bytes]) -> list[bytes]:
    """For each entry whether its trigger has one entry, equal phrases, different ones, or very many different ones, over all chunks."""
    counts = [len(p) // 13 for p in payloads]
    seeds = np.concatenate([ck.unpack40(p[: 5 * n]) for p, n in zip(payloads, counts, strict=True)])
    names = np.concatenate([np.frombuffer(p, "<u8", n, 5 * n) for p, n in zip(payloads, counts, strict=True)])
    order = np.argsort(seeds, kind="stable")
    ranked, named = seeds[order], names[order]
    begin = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] + np.uint64(1)))
    size = np.diff(np.append(begin, len(ranked)))
    differ = np.maximum.reduceat(named, begin) != np.minimum.reduceat(named, begin)
    kind = np.where(size == 1, ALONE, np.where(differ, np.where(size > max(CROWD, SHARE * len(seeds)), HOT, MIXED), SAME)).astype(np.uint8)
    out = np.empty(len(seeds), np.uint8)
    out[order] = np.repeat(kind, size)
    return [x.tobytes() for x in np.split(out, np.cumsum(counts)[:-1])]


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks from 1 on; equal values share theirs."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])[: len(values)])
    return out


def parse_ranks(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The inverse suffix array of many sequences of ranks laid end to end, by prefix doubling.

    ``left`` is how many words of the own sequence start at each place. Equal suffixes share
    a rank; an end comes before any word.
    """
    ranks, depth, longest = dense(words), 1, int(left.max(initial=0))
    while depth < longest:
        following = np.zeros(len(ranks), np.int64)
        more = np.flatnonzero(left > depth)
        following[more] = ranks[more + depth]
        ranks = dense(ranks * (len(ranks) + 1) + following)
        depth *= 2
    return ranks


def dictionary_ranks(text: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The inverse suffix array, to depth ``LENGTH``, of phrase suffixes that start at ``place`` with ``left`` bytes."""
    strings = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(LENGTH, np.uint8)), LENGTH)[place]
    strings[np.arange(LENGTH) >= left[:, None]] = 0
    return dense(strings.view(f"S{LENGTH}").ravel())


def corpus_order(text: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places ``asked`` in the order of the ``LENGTH`` bytes that start there.

    ``text`` holds sequences of the given sizes end to end; each place asked has that many
    bytes of its own sequence. Windows whose rolling hash has a zero remainder cut the
    sequences into phrases that overlap by a window, so none of the phrase suffixes that are
    compared is a prefix of another: their order in the dictionary's suffix array decides,
    and among equal ones that of what follows, in the parse's suffix array.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    hit = np.zeros(len(text), bool)
    for at in range(0, len(text), SEGMENT):
        h = rolling(text[at : at + SEGMENT + SHORT_WINDOW - 1], SHORT_WINDOW)
        hit[at : at + len(h)] = h % np.uint64(SHORT_EVERY) == 0
    for back in range(1, SHORT_WINDOW + 1):
        hit[ends - back] = False
    hit[begins] = True
    first = np.flatnonzero(hit)
    row = np.searchsorted(ends, first, side="right")
    is_last = np.append(row[1:] != row[:-1], True)
    length = np.where(is_last, ends[row], np.append(first[1:], 0) + SHORT_WINDOW) - first
    # phrases are named by hashes of their bytes and lengths
    begin = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(begin, length)
    letters = (text[np.repeat(first, length) + place].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    name = mixed(np.add.reduceat(letters, begin) + length.astype(np.uint64) * _K[1])
    _, shown, word = np.unique(name, return_index=True, return_inverse=True)
    # suffixes of the dictionary: of every phrase the whole, and those that start at a place asked
    mine = np.searchsorted(first, asked, side="right") - 1
    base = np.cumsum(length[shown]) - length[shown]
    entry = base[word[mine]] + asked - first[mine]
    wanted = np.zeros(length[shown].sum(), bool)
    wanted[base] = True
    wanted[entry] = True
    held = np.flatnonzero(wanted)
    phrase = np.searchsorted(base, held, side="right") - 1
    ranks = np.zeros(len(wanted), np.int64)
    ranks[held] = dictionary_ranks(text, first[shown][phrase] + held - base[phrase], length[shown][phrase] - held + base[phrase])
    # suffixes of the parse, in the order of whole phrases
    after = parse_ranks(ranks[base][word], np.searchsorted(row, row, side="right") - np.arange(len(row)))
    following = np.append(after, 0)[mine + 1]
    following[is_last[mine]] = 0
    return np.argsort(ranks[entry] * (len(first) + 1) + following)


def repeated_masks(text: np.ndarray, many: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each phrase a bit mask of its starts whose string a phrase with a smaller document id has."""
    sizes = many + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(many)), many)
    start = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
    asked = begins[phrase] + start
    order = corpus_order(text, sizes, asked)
    words = words_at(text)
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for offset in _WORDS:
        own = words[asked[order] + offset]
        differs |= own[1:] != own[:-1]
    begin = np.flatnonzero(np.append(True, differs))
    size = np.diff(np.append(begin, len(order)))
    docs = least[phrase[order]]
    hit = np.repeat(np.minimum.reduceat(docs, begin), size) < docs
    masks = np.zeros(len(many), np.uint32)
    np.bitwise_or.at(masks, phrase[order][hit], np.uint32(1) << start[order][hit].astype(np.uint32))
    return whole_masks(masks, many)


def batched_masks(seeds: np.ndarray, many: np.ndarray, least: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``repeated_masks`` of whole triggers, ``BATCH`` bytes and the rest of a trigger at a time."""
    sizes = many + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(seeds, kind="stable")
    edges = np.flatnonzero(np.append(np.diff(seeds[order], prepend=seeds[order][:1]) != 0, True))
    reach = np.cumsum(sizes[order])
    out, lo = np.zeros(len(many), np.uint32), 0
    while lo < len(order):
        full = np.searchsorted(reach, (reach[lo - 1] if lo else 0) + BATCH)
        hi = int(edges[min(np.searchsorted(edges, max(full, lo + 1)), len(edges) - 1)])
        own = order[lo:hi]
        offset = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        out[own] = repeated_masks(text[np.repeat(begins[own], sizes[own]) + offset], many[own], least[own])
        lo = hi
    return out


def detail_answer(payloads: list[bytes]) -> list[bytes]:
    """Least document ids of equal phrases, masks of the others, whether an earlier document has a hot trigger's string."""
    sizes = [struct.unpack_from("<III", p) for p in payloads]
    hashes, leasts, docs, manys, seeds, texts, dealt = [], [], [], [], [], [], []
    for p, (n, m, strings) in zip(payloads, sizes, strict=True):
        at = 12
        hashes.append(np.frombuffer(p, np.uint64, n, at))
        leasts.append(np.frombuffer(p, np.int64, n, at := at + 8 * n))
        dealt.append(np.frombuffer(p, np.int64, 3 * strings, at := at + 8 * n).reshape(3, -1))
        docs.append(np.frombuffer(p, np.int64, m, at := at + 24 * strings))
        manys.append(np.frombuffer(p, np.uint8, m, at := at + 8 * m))
        seeds.append(ck.unpack40(p[at + m : at + 6 * m]))
        texts.append(np.frombuffer(p, np.uint8, offset=at + 6 * m) if m else np.zeros(0, np.uint8))
    every, least = np.concatenate(hashes), np.concatenate(leasts)
    lowest = least
    if len(every):
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        lowest = np.empty_like(least)
        lowest[order] = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(order))))
    masks = batched_masks(np.concatenate(seeds), np.concatenate(manys).astype(np.int64), np.concatenate(docs), np.concatenate(texts))
    before = earlier_strings(*np.concatenate(dealt, axis=1))
    out, i, j, k = [], 0, 0, 0
    for n, m, strings in sizes:
        out.append(lowest[i : i + n].tobytes() + masks[j : j + m].tobytes() + before[k : k + strings].tobytes())
        i, j, k = i + n, j + m, k + strings
    return out


def earlier_strings(first: np.ndarray, second: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each (name in two numbers, document id) whether the name comes with a smaller id too."""
    if not len(first):
        return np.zeros(0, np.uint8)
    order = np.lexsort((second, first))
    first, second, ranked = first[order], second[order], least[order]
    begin = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    out = np.zeros(len(least), np.uint8)
    out[order] = np.repeat(np.minimum.reduceat(ranked, begin), np.diff(np.append(begin, len(ranked)))) < ranked
    return out


# --- tables ---


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row.

    ``spans`` are the maximal removed runs as a flat array of byte offsets (start, end,
    start, end ...), ``kept`` the remaining bytes. Removed is each byte covered by a 50-byte
    string that also starts in a document with a smaller id, judged on the input. A null
    text is empty. Rows with equal ids never remove each other's bytes; a row whose id is
    null keeps all its bytes and removes none. Other columns are left out.
    """
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    n = ck.buckets(docs, text_col)
    table = ck.chunk_table(docs, n, id_col, text_col)
    names = ck.resolve(ck.ask(table, lambda t: Parse(t, n).names()), name_answer, "phrase-kinds")
    details = ck.resolve(ck.ask_again(table, names, lambda t, r: Parse(t, n).details(r)), detail_answer, "phrase-details")

    def finish(rows: pa.Table, first: dict[int, bytes], second: dict[int, bytes]) -> pa.Table:
        parse = Parse(rows, n)
        gone = parse.removed(first, second)
        spans, kept = [], []
        for end, size in zip(parse.ends.tolist(), parse.sizes.tolist(), strict=True):
            own = gone[end - size : end]
            edges = np.flatnonzero(np.diff(own.view(np.int8), prepend=0, append=0))
            spans.append(edges.tolist())
            kept.append(parse.data[end - size : end][~own].tobytes() if len(edges) else parse.data[end - size : end].tobytes())
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(parse.sizes), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    return ck.conclude(table, [names, details], finish, "doc_id long, n_bytes long, spans array<long>, kept binary")


def digests(deduplicated: DataFrame) -> DataFrame:
    """Counts and digests of a deduplicated table."""
    lengths = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0)), F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.get("spans", i + 1) - F.get("spans", i), F.lit(0)))
    return deduplicated.select("doc_id", "n_bytes", lengths.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The definition in DuckDB SQL, on hexadecimal text (two digits a byte).
ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, a, substr(x, 2 * a + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS a FROM h)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.doc_id, a FROM w JOIN m USING (s) WHERE least < w.doc_id),
i AS (
  SELECT doc_id, a, sum(CASE WHEN a <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS run
  FROM (SELECT *, lag(a) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r)),
spans AS (SELECT doc_id, min(a) AS s, max(a) + 50 AS e FROM i GROUP BY doc_id, run),
cut AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM spans),
kept AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS behind, string_agg(substr(x, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS front
  FROM cut JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(behind, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)"""
