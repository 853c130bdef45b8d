import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellframe.llm import gif
from cellframe.llm.registry import QUERIES


@pytest.mark.parametrize("size", [192, 254 * 192, 255 * 192, 192 * 1024, 192 * 1025, 192 * 2500])
@pytest.mark.parametrize("compress", [False, True])
def test_payloads_come_back(size, compress):
    rng = np.random.default_rng(size)
    payload = bytes(rng.integers(0, 256, size, np.uint8)) if size % 5 else b"abab " * (size // 5) + b"x" * (size % 5)
    back = gif.parse(gif.write_bytes(payload, compress))
    assert b"".join(f.pixels.tobytes() for f in back.frames) == payload
    assert sum(n for _, n in [(0, f.width * f.height) for f in back.frames]) == size


@pytest.mark.parametrize("min_size", [2, 3, 5, 8])
def test_code_streams(min_size):
    rng = random.Random(min_size)
    for kind in range(4):
        n = [1, 50, 5000, 60_000][kind]
        pixels = bytes(rng.choices(range(1 << min_size), weights=[1 + 40 * (i == kind) for i in range(1 << min_size)], k=n))
        assert gif.decode_lzw(gif.encode_lzw(pixels, min_size), min_size, n).tobytes() == pixels


def test_literal_streams_decode_code_by_code_too(monkeypatch):
    pixels = bytes(range(256)) * 5
    data = gif.pack_literals(np.frombuffer(pixels, np.uint8))
    assert gif.unpack_literals(data, len(pixels)).tobytes() == pixels
    with pytest.raises(ValueError):
        gif.decode_lzw(data + b"\0", 8, len(pixels) + 1)
    monkeypatch.setattr(gif, "unpack_literals", lambda data, n: None)
    assert gif.decode_lzw(data, 8, len(pixels)).tobytes() == pixels


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([2, 4, 8]))
def test_any_pixels(pixels, min_size):
    pixels = bytes(p % (1 << min_size) for p in pixels)
    data = gif.encode_lzw(pixels, min_size)
    assert gif.decode_lzw(data, min_size, len(pixels)).tobytes() == pixels
    assert plain_decode(data, min_size) == pixels


def plain_decode(data, min_size):
    """The format's algorithm, bit by bit."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    bits = [data[i >> 3] >> (i & 7) & 1 for i in range(8 * len(data))]
    out, at, table, size, previous = b"", 0, {}, min_size + 1, None
    while True:
        code = sum(b << k for k, b in enumerate(bits[at : at + size]))
        at += size
        if code == clear:
            table, size, previous = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            following = end + 1
        elif code == end:
            return out
        else:
            entry = table[code] if code in table else previous + previous[:1]
            if previous is not None and following < 4096:
                table[following] = previous + entry[:1]
                following += 1
                if following == 1 << size and size < 12:
                    size += 1
            out, previous = out + entry, entry


def test_long_streams_by_the_plain_algorithm():
    pixels = bytes(np.random.default_rng(1).integers(0, 256, 9000, np.uint8)) + b"the same words " * 3000
    assert plain_decode(gif.encode_lzw(pixels), 8) == pixels

def test_palettes_disposal_and_transparency():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    shape = lambda *args, **kw: gif.image(*args, min_size=2, **kw)
    data = gif.screen(4, 4, palette) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\x00\x00"
    data += gif.control(7, 1) + shape(0, 0, 4, 4, bytes([1] * 16))
    data += gif.control(3, 3, 0) + shape(1, 1, 2, 2, bytes([2, 0, 0, 2]))
    data += gif.control(4, 2) + shape(0, 0, 2, 2, bytes([3] * 4))
    data += gif.control(0, 0) + shape(3, 3, 1, 1, bytes([0]), palette=bytes([9, 9, 9] * 4))
    parsed = gif.parse(data + b"\x3b")
    assert parsed.loops == 5 and [f.delay_ms for f in parsed.frames] == [70, 30, 40, 0]
    views = [canvas.copy() for _, canvas in gif.composed(parsed)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert (views[0] == red).all()
    assert (views[1][1, 1] == green).all() and (views[1][1, 2] == red).all()
    assert (views[2][0, 0] == blue).all() and (views[2][1, 1] == blue).all() and (views[2][2, 2] == red).all()
    assert (views[3][0, 0] == 0).all() and views[3][3, 3].tolist() == [9, 9, 9, 255]
    assert gif.histogram(views[1])[0b110000] == 14 and gif.histogram(views[1])[0b001100] == 2
    assert gif.histogram(views[3]).sum() == 12


def test_interlaced_rows():
    rows = bytes(i for i in [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)])
    data = bytearray(gif.screen(1, 10, gif.GREY.tobytes()) + gif.image(0, 0, 1, 10, rows))
    at = len(gif.screen(1, 10, gif.GREY.tobytes())) + 9
    data[at] |= 0x40
    assert gif.parse(bytes(data) + b"\x3b").frames[0].pixels.ravel().tolist() == list(range(10))


def test_broken_files():
    good = gif.write_bytes(b"x" * 192)
    for bad in (b"", b"GIF88a", good[:50], good[:-1], good[:-40]):
        with pytest.raises(ValueError):
            gif.parse(bad)


def test_headers_that_claim_too_much(spark):
    huge = gif.screen(65535, 65535, gif.GREY.tobytes()) + gif.image(0, 0, 65535, 65535, b"abc") + b"\x3b"
    with pytest.raises(ValueError, match="early"):
        gif.parse(huge)
    canvas = gif.screen(65535, 65535, gif.GREY.tobytes()) + gif.image(0, 0, 1, 1, b"a") + b"\x3b"
    with pytest.raises(ValueError, match="canvas"):
        gif.features(gif.parse(canvas))
    media = spark.createDataFrame([(1, huge), (2, canvas), (3, gif.write_bytes(b"x" * 192))], "doc_id long, media binary")
    assert [r.media_id for r in gif.frames_table(media).collect()] == [3]


def test_tables(spark):
    rows = [(1, "text", "m"), (2, None, "m"), (2, None, "m"), (None, "", "m"), (3, "é" * 150_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = gif.read_media(gif.store_texts(docs)).collect()
    assert len(got) == 5 and gif.read_media(gif.store_texts(docs.limit(0))).count() == 0
    for r, text in zip(got, [r[1] for r in rows], strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    frames = gif.frames_table(gif.store_texts(docs)).filter("media_id = 3").orderBy("frame").collect()
    assert [(f.frame, f.start_ms, f.delay_ms) for f in frames] == [(0, 0, 100), (1, 100, 100)]
    broken = spark.createDataFrame([(1, b"no"), (2, None)], "doc_id long, media binary")
    assert gif.frames_table(broken).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op10_gif_media"](spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in docs:
        _, payload = gif.padded(text)
        data = gif.write_bytes(payload)
        r = got[doc_id]
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), len(data), hashlib.sha256(data).hexdigest())
        counts = np.bincount(np.frombuffer(payload, np.uint8) >> 6, minlength=4)
        assert r.feature.split("rgb64[")[1] == ";".join(f"{21 * i}={n}" for i, n in enumerate(counts.tolist()) if n) + "]"


def test_null_and_broken_media(spark):
    whole = gif.store_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()[0].media
    rows = [(1, 1, bytes(whole)), (2, None, None), (3, 0, b""), (4, 5, bytes(whole[:-40])), (5, 1, b"GIF89a")]
    got = {r.doc_id: r for r in gif.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == 5 and got[1].payload_bytes == 192 and got[2].media_bytes is None and got[4].media_bytes == len(whole) - 40
    assert all(got[k].payload_sha256 is None and got[k].feature is None for k in (2, 3, 4, 5))


def test_many_files_are_coded_together(monkeypatch):
    rng = random.Random(3)
    payloads = [gif.padded("".join(rng.choices("etaoin shrdlu", k=rng.choice([1, 300, 9000, 20_000]))))[1] for _ in range(60)]
    payloads += [bytes(rng.choices(range(256), k=192 * 50)), b" " * 192 * 2100, bytes(192 * 60)]
    alone = [gif.write_bytes(p) for p in payloads]
    expected = [gif.encode_lzw(p) for p in payloads]

    def refused(*_):
        raise AssertionError("pixel by pixel")

    monkeypatch.setattr(gif, "_run_codes", refused)
    monkeypatch.setattr(gif, "decode_lzw", refused)
    assert gif.write_all(payloads) == alone and gif.encode_streams(payloads) == expected
    broken = [b"no", None, alone[0][:50]]
    back = list(gif.parse_all([*alone, *broken]))
    assert [b"".join(f.pixels.tobytes() for f in x.frames) for x in back[:-3]] == payloads and back[-3:] == [None] * 3
    assert plain_decode(expected[-3], 8) == payloads[-3]


def test_full_tables_and_one_bad_stream():
    noise = bytes(np.random.default_rng(5).integers(0, 256, gif.RUN + 900, np.uint8))
    data = gif.encode_lzw(noise)  # over 3838 codes to a run
    assert plain_decode(data, 8) == noise and gif.decode_streams([(data, 8, len(noise))])[0].tobytes() == noise
    good, cut = gif.write_bytes(b"x" * 1920), gif.write_bytes(b"y" * 1920)
    cut = cut.replace(gif.blocked(gif.encode_lzw(b"y" * 1920)), gif.blocked(gif.encode_lzw(b"y" * 200)))
    assert [x is not None for x in gif.parse_all([good, cut, good])] == [True, False, True]


def test_canvases_over_the_limit_keep_their_rows(spark):
    huge = gif.screen(65535, 65535, gif.GREY.tobytes()) + gif.image(0, 0, 1, 1, b"a") + b"\x3b"
    (row,) = gif.read_media(spark.createDataFrame([(1, 1, huge)], "doc_id long, n_bytes long, media binary")).collect()
    assert row.media_bytes == len(huge) and row.payload_sha256 is None and row.feature is None
