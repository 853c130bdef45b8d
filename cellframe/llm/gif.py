"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

``write_bytes`` stores a byte string as the pixels of a GIF, ``parse`` decodes any GIF,
``composed`` applies disposal and transparency, ``histogram`` counts colours.

The writer compresses; with ``compress=False`` it emits literal codes with a clear code
before the table can grow past nine bits, a valid stream of 9/8 of the size that packs
without a loop over pixels. The reader takes either and any other stream.

Tables are written and read many files at a time: runs of pixels between clear codes know
nothing of each other, so one array operation takes the next pixel of all of them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import SLICE, keyed_text, map_batches

WIDTH = 192
ROWS = 1024
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
EMPTY = np.zeros(0, np.uint8)
LITERALS = 254
#: Pixels of a run: a clear code stands between two, so that runs are encoded side by side.
RUN = 8192
#: Places of a run's table of strings, and how many runs have tables at once (32 MB).
SLOTS_LOG2, LANES = 13, 1024
#: Fewer runs than this are encoded one by one, to the same codes.
FEW = 48
#: Odd, and its product with a string's key (20 bits) spreads in the upper of 32 bits.
SPREAD = 2654435769
#: Pixels and bytes of code streams that are decoded at once, a whole file at least.
GROUP = 1 << 20
#: A canvas of more pixels is refused: its four bytes a pixel would come from the header alone.
MOST_PIXELS = 1 << 26
#: What ``parse`` raises for bytes that are no whole GIF.
BROKEN = (ValueError, IndexError, struct.error)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    pixels: np.ndarray
    palette: np.ndarray
    transparent: int | None = None
    disposal: int = 0
    delay_ms: int = 0


@dataclass
class Gif:
    width: int
    height: int
    background: np.ndarray | None
    loops: int | None
    frames: list[Frame]


# --- code streams ---


def pack_literals(pixels: np.ndarray) -> bytes:
    """Nine-bit codes: a clear code before every 254 literals, the end code last."""
    n = len(pixels)
    groups = -(-n // LITERALS)
    codes = np.full((groups, LITERALS + 1), 256, np.uint16)
    body = np.zeros(groups * LITERALS, np.uint16)
    body[:n] = pixels
    codes[:, 1:] = body.reshape(groups, LITERALS)
    flat = codes.reshape(-1)[: n + groups]
    total = len(flat) + 1
    padded = np.zeros(-(-total // 8) * 8, np.uint16)
    padded[: total - 1] = flat
    padded[total - 1] = 257
    eight = padded.reshape(-1, 8)
    out = np.empty((len(eight), 9), np.uint8)
    for k in range(9):
        low = eight[:, k - 1] >> (9 - k) if k else 0
        high = (eight[:, k] << k) if k < 8 else 0
        out[:, k] = (low | high) & 255
    return out.tobytes()[: -(-9 * total // 8)]


def unpack_literals(data: bytes, n: int) -> np.ndarray | None:
    """The pixels of a stream of the form above, else None."""
    groups = -(-n // LITERALS)
    total = n + groups + 1
    if not n or len(data) < -(-9 * total // 8):  # nothing is allocated for a stream too short
        return None
    blocks = -(-total // 8)
    raw = np.zeros(blocks * 9, np.uint8)
    got = np.frombuffer(data, np.uint8)[: blocks * 9]
    raw[: len(got)] = got
    nine = raw.reshape(-1, 9).astype(np.uint16)
    codes = np.empty((blocks, 8), np.uint16)
    for j in range(8):
        codes[:, j] = ((nine[:, j] >> j) | (nine[:, j + 1] << (8 - j))) & 511
    flat = codes.reshape(-1)
    if flat[total - 1] != 257:
        return None
    grid = np.full(groups * (LITERALS + 1), 0, np.uint16)
    grid[: total - 1] = flat[: total - 1]
    grid = grid.reshape(groups, LITERALS + 1)
    body = grid[:, 1:].reshape(-1)[:n]
    if (grid[:, 0] != 256).any() or (body > 255).any():
        return None
    return body.astype(np.uint8)


def _widths(min_size: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: the table gains an entry with each code but the first."""
    entries = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


@lru_cache(maxsize=16)
def _first_widths(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code up to the widest, and where each ends; all further ones have 12 bits."""
    widths = _widths(min_size, 4096)
    return widths, np.cumsum(widths)


def _code_runs(data: bytes, min_size: int) -> Iterator[np.ndarray]:
    """The codes between clear codes, up to the end code or the end of the data."""
    raw = np.zeros(len(data) + 4, np.uint32)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    clear, end, limit = 1 << min_size, (1 << min_size) + 1, 8 * len(data)
    at, step = 0, 4096
    while at < limit:
        run: list[np.ndarray] = []
        while True:
            widths, ends = _first_widths(min_size) if not run else (np.full(step, 12), np.arange(12, 12 * step + 1, 12))
            whole = int(np.searchsorted(ends, limit - at, side="right"))
            widths, ends = widths[:whole], ends[:whole] + at
            offsets = ends - widths
            byte = offsets >> 3
            window = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
            codes = window >> (offsets & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            n = int(stop[0]) if len(stop) else whole
            run.append(codes[:n])
            at = int(ends[n]) if len(stop) else int(ends[-1]) if whole else limit
            if len(stop) or whole < step:
                break
        yield np.concatenate(run).astype(np.int64)
        if not len(stop) or codes[n] == end:
            return


def decode_lzw(data: bytes, min_size: int, n: int) -> np.ndarray:
    """``n`` pixels of any code stream; one that ends early raises, what is too much is left out.

    Memory follows what the stream holds, not what its header claims.

    Bits become codes a run at a time, since their widths follow from their places after
    the clear code; codes become strings one by one. A code beyond the table raises.
    """
    if min_size == 8 and (quick := unpack_literals(data, n)) is not None:
        return quick
    first = [bytes([i]) for i in range(1 << min_size)] + [b"", b""]
    out: list[bytes] = []
    length = 0
    for run in map(np.ndarray.tolist, _code_runs(data, min_size)):
        if not run:
            continue
        if length >= n:
            break
        table = list(first)
        if run[0] >= len(first):
            raise ValueError("a code beyond the table")
        previous = table[run[0]]
        strings = [previous]
        add, keep = table.append, strings.append
        room = 4096 - len(table)
        for code in run[1 : room + 1]:
            if code < len(table):
                entry = table[code]
                add(previous + entry[:1])
            elif code == len(table):
                entry = previous + previous[:1]
                add(entry)
            else:
                raise ValueError("a code beyond the table")
            keep(entry)
            previous = entry
        strings += [table[code] for code in run[room + 1 :]]
        joined = b"".join(strings)
        length += len(joined)
        out.append(joined)
    if length < n:
        raise ValueError("the code stream ends early")
    return np.frombuffer(b"".join(out), np.uint8)[:n].copy()


def _strings(codes: np.ndarray, starts: np.ndarray, clear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(length, code it extends or itself, last pixel) of each code's string, all runs at once; None if a code is beyond its table.

    The entry that a code names was begun by an earlier code of its run: its string is that
    code's and the first pixel of the next one's. Following these steps, twice as far each
    time, leads to the pixel a string begins with and tells how long it is.
    """
    here = np.arange(len(codes))
    named = codes - clear - 2
    if (named >= here - starts).any():
        return None
    single = codes < clear
    parent = np.where(single, here, starts + named)
    root, steps = parent, (~single).astype(np.int64)
    while len(late := np.flatnonzero(~single[root])):
        steps[late] += steps[root[late]]
        root = root[root]
    first = codes[root]
    return steps + 1, parent, np.where(single, codes, first[np.minimum(parent + 1, len(codes) - 1)])


def decode_streams(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray | None]:
    """``n`` pixels of each (stream, code size, n); None where it is no plain stream of so many.

    Strings are written back to front, a pixel of all strings at a time, each from the end of
    the one that it extends.
    """
    runs, owners = [], []
    for owner, (data, min_size, _) in enumerate(streams):
        for run in _code_runs(data, min_size):
            if len(run):
                runs.append(run)
                owners.append(owner)
    if not runs:
        return [None] * len(streams)
    sizes, owners = np.array([len(r) for r in runs]), np.array(owners)
    clears = np.array([1 << size for _, size, _ in streams])
    made = _strings(np.concatenate(runs), np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(clears[owners], sizes))
    if made is None:
        return [None] * len(streams)
    lengths, parent, last = made
    of_code = np.repeat(owners, sizes)
    totals = np.bincount(of_code, weights=lengths, minlength=len(streams)).astype(np.int64)
    fits = totals == [n for _, _, n in streams]
    lengths = np.where(fits[of_code], lengths, 0)
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]), np.uint8)
    code = np.flatnonzero(lengths)
    place, last = ends[code] - 1, last.astype(np.uint8)
    longer = np.flatnonzero(lengths[code] > 1)
    out[place] = last[code]
    while len(longer):
        code, place = parent[code[longer]], place[longer] - 1
        out[place] = last[code]
        longer = np.flatnonzero(parent[code] != code)
    ends = np.cumsum(np.where(fits, totals, 0))
    return [out[end - n : end] if ok else None for ok, n, end in zip(fits.tolist(), totals.tolist(), ends.tolist(), strict=True)]


def encode_lzw(pixels: bytes, min_size: int = 8) -> bytes:
    """A compressed stream; see ``encode_streams``."""
    return encode_streams([pixels], min_size)[0]


def encode_streams(images: list[bytes], min_size: int = 8) -> list[bytes]:
    """A compressed stream of each image's pixels; the table is cleared after every ``RUN`` pixels."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    runs = [image[at : at + RUN] for image in images for at in range(0, len(image), RUN)]
    order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
    made: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        few = len(some) < FEW
        for k, codes in zip(some, [_run_codes(runs[k], min_size) for k in some] if few else _lane_codes([runs[k] for k in some], min_size), strict=True):
            made[k] = codes
    codes, widths, counts, k = [], [], [], 0
    own, narrow = _first_widths(min_size)[0], np.array([min_size + 1])
    for image in images:
        mine = made[k : k + -(-len(image) // RUN)] or [np.zeros(0, np.int64)]
        k += -(-len(image) // RUN)
        widths.append(narrow)
        for run in mine:
            codes += [[clear], run]
            widths.append(own[: len(run) + 1] if len(run) < len(own) else _widths(min_size, len(run) + 1))
        codes.append([end])
        counts.append(sum(map(len, mine)) + len(mine) + 1)
    return _packed(np.concatenate(codes), np.concatenate(widths), np.array(counts)) if images else []


def _run_codes(pixels: bytes, min_size: int) -> np.ndarray:
    """The codes of one run, pixel by pixel.

    A place of the table keeps the last string that fell on it, so a string may be learnt twice:
    codes are a few more than they could be, and valid all the same. Code 4095 is not used.
    """
    table: dict[int, int] = {}
    get, codes = table.get, []
    put, following, down = codes.append, (1 << min_size) + 2, 32 - SLOTS_LOG2
    rest = iter(pixels)
    current = next(rest)
    for value in rest:
        key = current << 8 | value
        place = (key * SPREAD & 0xFFFFFFFF) >> down
        known = get(place, -1)
        if known >> 12 == key:
            current = known & 4095
            continue
        put(current)
        current = value
        if following < 4095:
            table[place] = key << 12 | following
            following += 1
    put(current)
    return np.array(codes, np.int64)


def _lane_codes(runs: list[bytes], min_size: int) -> list[np.ndarray]:
    """``_run_codes`` of each run, longest first: each step takes one pixel of all runs that still have one."""
    lengths = np.array([len(r) for r in runs])
    counts = np.searchsorted(-lengths, -np.arange(lengths[0] + 1))  # runs that have a pixel t
    begins = np.cumsum(counts) - counts
    values = np.empty(int(lengths.sum()), np.uint32)
    for lane, run in enumerate(runs):
        values[begins[: len(run)] + lane] = np.frombuffer(run, np.uint8)
    emitted, isnew = np.empty(len(values), np.uint16), np.empty(len(values), bool)
    table = np.full(len(runs) << SLOTS_LOG2, 0xFFFFFFFF, np.uint32)
    base = np.arange(len(runs)) << SLOTS_LOG2
    down, eight, twelve, low, spread = map(np.uint32, (32 - SLOTS_LOG2, 8, 12, 4095, SPREAD))
    following = np.full(len(runs), (1 << min_size) + 2, np.uint32)
    current, last = values[: len(runs)], np.empty(len(runs), np.uint32)
    for t, (n, at) in enumerate(zip(counts[1:].tolist(), begins[1:].tolist(), strict=True), 1):
        if n < len(current):
            last[n : len(current)] = current[n:]
            current, base, following = current[:n], base[:n], following[:n]
        value = values[at : at + n]
        key = current << eight
        key |= value
        place = base + (key * spread >> down)
        known = table[place]
        new = known >> twelve != key
        emitted[at : at + n], isnew[at : at + n] = current, new
        current = np.where(new, value, known & low)
        if t >= 4093 - (1 << min_size):  # before, no table can be full
            new &= following < 4095
        key <<= twelve
        key |= following
        table[place] = np.where(new, key, known)
        following += new
    out = []
    for lane, run in enumerate(runs):
        own = begins[1 : len(run)] + lane
        out.append(np.concatenate([emitted[own][isnew[own]], last[lane : lane + 1]]).astype(np.int64))
    return out


def _packed(codes: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Streams of so many codes of given widths, lowest bit first; bits never overlap, so bytes are sums."""
    ends = np.cumsum(widths)
    behind = np.cumsum(counts)
    bits = np.diff(ends[behind - 1], prepend=0)
    sizes = (bits + 7) >> 3
    stops = np.cumsum(sizes)
    offsets = ends - widths + np.repeat(8 * (stops - sizes) - (ends[behind - 1] - bits), counts)
    shifted = codes << (offsets & 7)
    place, room = offsets >> 3, int(stops[-1]) + 3
    total = np.zeros(room)
    for k in range(3):
        total += np.bincount(place + k, weights=shifted >> 8 * k & 255, minlength=room)
    data = total.astype(np.uint8).tobytes()
    return [data[stop - size : stop] for stop, size in zip(stops.tolist(), sizes.tolist(), strict=True)]


# --- files ---


def blocked(data: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes, each behind its length, and the empty last one."""
    whole = len(data) // 255
    grid = np.empty((whole, 256), np.uint8)
    grid[:, 0] = 255
    grid[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return grid.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def unblocked(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from ``at``, and the place behind them."""
    whole = 0
    while data[at + 256 * whole] == 255:
        whole += 1
    parts = [np.frombuffer(data, np.uint8, 256 * whole, at).reshape(whole, 256)[:, 1:].tobytes()]
    at += 256 * whole
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def control(delay_cs: int = 0, disposal: int = 0, transparent: int | None = None) -> bytes:
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay_cs, transparent or 0, 0)


def image(left: int, top: int, width: int, height: int, pixels: bytes, palette: bytes = b"", min_size: int = 8, compress: bool = True) -> bytes:
    codes = encode_lzw(pixels, min_size) if compress or min_size != 8 else pack_literals(np.frombuffer(pixels, np.uint8))
    return framed(left, top, width, height, codes, palette, min_size)


def framed(left: int, top: int, width: int, height: int, codes: bytes, palette: bytes = b"", min_size: int = 8) -> bytes:
    flags = 0x80 | ((len(palette) // 3).bit_length() - 2) if palette else 0
    return struct.pack("<BHHHHB", 0x2C, left, top, width, height, flags) + palette + bytes([min_size]) + blocked(codes)


def screen(width: int, height: int, palette: bytes = b"", background: int = 0) -> bytes:
    flags = 0x80 | 0x70 | ((len(palette) // 3).bit_length() - 2) if palette else 0x70
    return b"GIF89a" + struct.pack("<HHBBB", width, height, flags, background, 0) + palette


def write_bytes(payload: bytes, compress: bool = True) -> bytes:
    """The payload, a positive multiple of 192 bytes, as grey pixels 192 wide, 1024 rows to a frame of 0.1 s."""
    return write_all([payload], compress)[0]


def write_all(payloads: list[bytes], compress: bool = True) -> list[bytes]:
    """``write_bytes`` of each payload."""
    if any(not p or len(p) % WIDTH for p in payloads):
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    frames = [[p[at : at + ROWS * WIDTH] for at in range(0, len(p), ROWS * WIDTH)] for p in payloads]
    flat = [pixels for own in frames for pixels in own]
    streams = iter(encode_streams(flat) if compress else [pack_literals(np.frombuffer(p, np.uint8)) for p in flat])
    out, grey = [], GREY.tobytes()
    for own in frames:
        parts = [screen(WIDTH, len(own[0]) // WIDTH, grey)]
        for pixels in own:
            parts += [control(10, 1), framed(0, 0, WIDTH, len(pixels) // WIDTH, next(streams))]
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def parse(data: bytes) -> Gif:
    """Frames with their own pixels, palettes and timing; what is not a GIF raises ValueError."""
    gif, streams = outline(data)
    return filled(gif, [s[:3] for s in streams], [s[3] for s in streams], decode_streams([s[:3] for s in streams]))


def parse_all(files: Iterable[bytes | None]) -> Iterator[Gif | None]:
    """``parse`` of each file, None where it is none; streams are decoded together while they and their pixels are within ``GROUP``."""
    held: list[tuple[Gif | None, list[tuple[bytes, int, int, bool]]]] = []
    size = 0

    def out() -> Iterator[Gif | None]:
        pixels = iter(decode_streams([s[:3] for _, streams in held for s in streams]))
        for gif, streams in held:
            own = [next(pixels) for _ in streams]
            try:
                yield gif and filled(gif, [s[:3] for s in streams], [s[3] for s in streams], own)
            except BROKEN:
                yield None

    for data in files:
        try:
            gif, streams = outline(data or b"")
        except BROKEN:
            gif, streams = None, []
        more = sum(len(codes) + n for codes, _, n, _ in streams)
        if held and size + more > GROUP:
            yield from out()
            held, size = [], 0
        held.append((gif, streams))
        size += more
    yield from out()


def filled(gif: Gif, streams: list[tuple[bytes, int, int]], woven: list[bool], pixels: list[np.ndarray | None]) -> Gif:
    """The outline with its pixels; streams that gave none are decoded code by code, which raises ValueError for broken ones."""
    for f, stream, interlaced, flat in zip(gif.frames, streams, woven, pixels, strict=True):
        f.pixels = (decode_lzw(*stream) if flat is None else flat).reshape(f.height, f.width)
        if interlaced:
            h = f.height
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(f.pixels)
            straight[order] = f.pixels
            f.pixels = straight
    return gif


def outline(data: bytes) -> tuple[Gif, list[tuple[bytes, int, int, bool]]]:
    """A file's frames without their pixels, and for each (stream, code size, pixels, whether its rows are interlaced)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        colours = np.zeros((256, 3), np.uint8)
        colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    shared = palette(flags)
    out, streams = Gif(width, height, shared[background] if shared is not None else None, None, []), []
    delay, disposal, transparent = 0, 0, None
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21 and data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
                at += 8
            elif data[at] == 0x21:
                body, behind = unblocked(data, at + 2)
                if data[at + 1] == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    out.loops = body[12] | body[13] << 8
                at = behind
            elif data[at] == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                own = palette(flags)
                colours = own if own is not None else shared if shared is not None else GREY
                size = data[at]
                if size > 8:
                    raise ValueError("pixels of more than eight bits")
                codes, at = unblocked(data, at + 1)
                streams.append((codes, size, w * h, bool(flags & 0x40)))
                out.frames.append(Frame(left, top, w, h, EMPTY, colours, transparent, disposal, 10 * delay))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e
    return out, streams


def composed(gif: Gif) -> Iterator[tuple[int, np.ndarray]]:
    """(delay in ms, canvas) of each frame; the canvas is RGBA and is reused. Over ``MOST_PIXELS`` raises ValueError."""
    if gif.width * gif.height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        bottom, right = min(f.top + f.height, gif.height), min(f.left + f.width, gif.width)
        area = canvas[f.top : bottom, f.left : right]
        pixels = f.pixels[: area.shape[0], : area.shape[1]]
        before = canvas.copy() if f.disposal == 3 else None
        colours = np.concatenate([f.palette, np.full((256, 1), 255, np.uint8)], axis=1)
        drawn = colours.view(np.uint32).ravel()[pixels].view(np.uint8).reshape(*pixels.shape, 4)
        if f.transparent is None:
            area[:] = drawn
        else:
            visible = pixels != f.transparent
            area[visible] = drawn[visible]
        yield f.delay_ms, canvas
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas[:] = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels in each of 64 colour cells: two bits of red, green and blue each."""
    words = np.ascontiguousarray(canvas).view("<u4").ravel()
    cell = (words >> 2 & 0x30) | (words >> 12 & 0x0C) | (words >> 22 & 0x03)
    if not canvas[..., 3].all():
        cell = cell[canvas[..., 3].ravel() > 0]
    return np.bincount(cell, minlength=64)


def features(gif: Gif) -> str:
    """Size, frames, duration and the summed histogram's non-empty cells."""
    total, duration = np.zeros(64, np.int64), 0
    for delay, canvas in composed(gif):
        duration += delay
        total += histogram(canvas)
    cells = ";".join(f"{i}={n}" for i, n in enumerate(total.tolist()) if n)
    return f"{gif.width}x{gif.height} frames={len(gif.frames)} ms={duration} rgb64[{cells}]"


# --- tables ---


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with spaces up to a positive multiple of 192)."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF.

    A null or empty text is one row of spaces. Repeated rows and null ids stay; other
    columns are left out; long texts become several frames.
    """

    def build():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            sized = [padded(t) for t in batch.column(1).to_pylist()]
            media = write_all([p for _, p in sized])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sized], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return convert

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(keyed_text(docs, id_col, text_col), build, f"doc_id {kind}, n_bytes long, media binary", 4 * SLICE)


def read_media(stored: DataFrame) -> DataFrame:
    """Decodes a (doc_id, n_bytes, media) table: payload digests, media digests and features.

    Null media has none of these, and media that is not a whole GIF, or whose canvas is over
    ``MOST_PIXELS``, only its own length and digest; the rows stay.
    """

    def build():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            files = batch.column(2).to_pylist()
            for data, gif in zip(files, parse_all(files), strict=True):
                own = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                if gif is None or gif.width * gif.height > MOST_PIXELS:
                    rows.append((None, None, None, *own, None))
                    continue
                payload = b"".join(f.pixels.tobytes() for f in gif.frames)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, features(gif)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", *names])

        return convert

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(stored.select("doc_id", "n_bytes", "media"), build, schema)


def frames_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each timed frame: start and delay in ms, rectangle, disposal, colour histogram.

    Null media, what is not a whole GIF, and a canvas over ``MOST_PIXELS`` give no rows.
    """

    def build():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, start = [], 0
                try:
                    gif = parse(data or b"")
                    for i, ((delay, canvas), f) in enumerate(zip(composed(gif), gif.frames, strict=True)):
                        own.append((key, i, start, delay, f.left, f.top, f.width, f.height, f.disposal, histogram(canvas).tolist()))
                        start += delay
                except BROKEN:
                    continue
                rows += own
            names = ["media_id", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "histogram"]
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 8, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        return convert

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"media_id {kind}, frame int, start_ms int, delay_ms int, left int, top int, width int, height int, disposal int, histogram array<long>"
    return map_batches(media.select(F.col(id_col).alias("media_id"), F.col(media_col).alias("media")), build, schema)
