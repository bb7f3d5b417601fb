import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tsumugi.llm import gif


def slow_lzw(codes_of, bits):
    """Plain reference: packs (code, width) pairs one bit at a time."""
    out = []
    for c, w in codes_of:
        out += [c >> i & 1 for i in range(w)]
    out += [0] * (-len(out) % 8)
    return bytes(sum(b << i for i, b in enumerate(out[k : k + 8])) for k in range(0, len(out), 8))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 255, 256, 5000, 200_000])
def test_lzw_round_trip(n):
    rnd = random.Random(n)
    for data in (bytes(n), bytes(rnd.randrange(256) for _ in range(n)), bytes(rnd.choice(b"abcd ") for _ in range(n))):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n + 5) == data


def test_decoder_reads_plain_streams_and_late_clears():
    # literals only, no clear code ever after the first: the table fills, then codes stay 12 bits wide
    data = bytes(i * 7 % 4 for i in range(9000))
    codes, nxt, width = [(4, 3)], 6, 3
    for k, c in enumerate(data):
        codes.append((c, width))
        if k:
            nxt = min(nxt + 1, 4096)
        if nxt == 1 << width and width < 12:
            width += 1
    codes.append((5, width))
    assert gif.lzw_decode(slow_lzw(codes, 2), 2, 9000) == data
    with pytest.raises(ValueError):
        gif.lzw_decode(slow_lzw([(4, 3), (1, 3), (7, 3)], 2), 2, 10)


def pic(w, h, frames, palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette
    for (x, y, fw, fh, px, disposal, clear, delay, flags, local) in frames:
        out += b"!\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear >= 0), delay, max(clear, 0)) + b"\0"
        s = gif.lzw_encode(bytes(px), 2)
        out += b"," + struct.pack("<HHHHB", x, y, fw, fh, flags) + local + b"\x02" + bytes([len(s)]) + s + b"\0"
    return out + b";"


def test_disposal_transparency_palettes_and_timing():
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    data = pic(2, 2, [
        (0, 0, 2, 2, [1, 1, 1, 1], 1, -1, 5, 0, b""),
        (0, 0, 1, 1, [2], 3, -1, 6, 0, b""),
        (1, 0, 1, 2, [0, 3], 2, 0, 7, 0, b""),
        (0, 1, 1, 1, [1], 0, -1, 8, 0x80, bytes([9, 9, 9, 8, 8, 8])),
    ])
    got = [(c.copy().tolist(), d) for _, c, d, *_ in gif.decode(data)]
    assert got[0] == ([[red, red], [red, red]], 50)
    assert got[1] == ([[green, red], [red, red]], 60)
    assert got[2] == ([[red, red], [red, blue]], 70)
    assert got[3] == ([[red, [0, 0, 0]], [[8, 8, 8], [0, 0, 0]]], 80)


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = pic(1, 9, [(0, 0, 1, 9, [r % 4 for r in rows], 0, -1, 0, 0x40, b"")])
    (px, *_), = gif.decode(data)
    assert px.ravel().tolist() == [r % 4 for r in range(9)]


def test_columns(spark):
    long = "äbc " * 90_000
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (4, long), (5, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "'q' as feature")
    got = {r.doc_id: r for r in gif.payloads(gif.store(df)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[4].feature.startswith("2:") and got[1].media_sha256 == got[2].media_sha256
    assert gif.payloads(gif.store(df.limit(0))).count() == 0
    f = gif.frames(gif.store(df), "doc_id").orderBy("doc_id", "frame_no").collect()
    last = [r for r in f if r.doc_id == 4]
    assert [r.at_ms for r in last] == [0, 40] and sum(last[0].hist) == 64 * 4096 and last[0].error is None
    bad = spark.createDataFrame([(1, b"GIF89a"), (2, gif.encode(bytes(64))[:-3]), (3, None), (4, b"")], "doc_id long, media binary")
    err = {r.doc_id: r.error for r in gif.frames(bad, "doc_id").collect() if r.error}
    assert set(err) == {1, 2, 4}


def test_huge_canvas_is_an_error(spark):
    import struct

    whole = gif.encode(bytes(64))
    huge = whole[:6] + struct.pack("<HH", 65535, 65535) + whole[10:]
    df = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(whole)), (3, None)], "k long, media binary")
    got = sorted((r.k, r.frame_no, r.error) for r in gif.frames(df, "k").collect())
    assert [g[:2] for g in got] == [(1, 0), (2, 0)] and "65535" in got[0][2] and got[1][2] is None


def test_frames_of_documents(spark, tmp_path):
    import hashlib

    texts = [None, "", "abc", "é" * 5000, "\x00\xff" * 200_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.frame_no): r for r in gif.gif_frames(spark, str(tmp_path)).collect()}
    want = 0
    for d, t in enumerate(texts):
        payload = gif.padded(t)[1]
        for k, at in enumerate(range(0, len(payload), 64 * gif.FRAME_ROWS)):
            part = payload[at : at + 64 * gif.FRAME_ROWS]
            r, want = got[d, k], want + 1
            assert (r.at_ms, r.delay_ms, r.width, r.height) == (40 * k, 40, 64, min(gif.FRAME_ROWS, len(payload) // 64))
            if len(part) // 64 == r.height:
                cells = [0] * 64
                for x in part:
                    cells[(x >> 6) * 21] += 1
                assert r.hist == ",".join(map(str, cells))
                assert r.rgb_sha256 == hashlib.sha256(bytes(x for x in part for _ in range(3))).hexdigest()
    assert len(got) == want
