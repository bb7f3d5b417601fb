"""Media columns: GIF.

The decoder reads LZW code streams (all code widths, late clear codes, interlacing), applies global and local palettes,
disposal (none, leave, background, previous) and transparency, and stores timed frames with colour-histogram columns.
The encoder makes GIF89a files of grey frames, byte = colour index, which hold any bytes without loss. Code widths
depend only on the number of codes since the last clear code, so bits are packed and unpacked in vectors; only the
string table is a loop.

A null media cell gives no frames; an empty or damaged one gives a row with `error` set and null frame columns. A null
or empty payload is padded to one row of 64 zero bytes. Canvases of more than MOST_PIXELS are refused with an error. Payloads of any length are stored: beyond FRAME_ROWS rows
another frame begins. Equal payloads give equal files. Repeated rows are kept. Other columns are dropped by `frames` and
`op3_gif`, kept by `store`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

WIDTH = 64
FRAME_ROWS = 4096
DELAY = 4  # hundredths of a second
MOST_PIXELS = 1 << 26  # of a canvas or a frame; a header can claim 2**32


def _widths(bits: int, n: int) -> np.ndarray:
    """Width of the j-th code after a clear code, for literals of `bits` bits."""
    nxt = (1 << bits) + 1 + np.arange(n)
    w = np.frexp(nxt.astype(np.float64))[1]
    w[0] = bits + 1
    return np.clip(w, bits + 1, 12).astype(np.int64)


_W = {b: _widths(b, 4096) for b in range(2, 9)}
_AT = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _W.items()}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear, first = 1 << bits, (1 << bits) + 2
    room = 4096 - first
    codes: list[int] = []
    ends: list[int] = []  # places in codes after which the table is cleared
    add = codes.append
    known: dict[int, int] = {}
    get = known.get
    prefix, left, new = -1, room, first
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        key = prefix << 8 | c
        t = get(key)
        if t is not None:
            prefix = t
            continue
        add(prefix)
        prefix = c
        known[key] = new
        new += 1
        if new == 4096:
            ends.append(len(codes))
            known.clear()
            new = first
    if prefix >= 0:
        add(prefix)
    flat, widths, at = [np.array([clear])], [np.array([bits + 1])], 0
    all_codes = np.array(codes, np.int64)
    for e in [*ends, len(codes)]:
        n = e - at
        flat += [all_codes[at:e], np.array([clear if e != len(codes) or (ends and e == ends[-1] and at != e) else clear + 1])]
        widths += [_W[bits][: n + 1]]
        at = e
    flat[-1][0] = clear + 1
    v, w = np.concatenate(flat), np.concatenate(widths)
    off = np.cumsum(w) - w
    size = int(off[-1] + w[-1] + 7) // 8
    x, b = v << (off & 7), off >> 3
    out = np.bincount(b, x & 255, size + 2) + np.bincount(b + 1, x >> 8 & 255, size + 2) + np.bincount(b + 2, x >> 16, size + 2)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """The indices of a code stream, `limit` at most; ValueError for a code that can't be."""
    if not 2 <= bits <= 8:
        raise ValueError(f"literals of {bits} bits")
    clear, end = 1 << bits, (1 << bits) + 1
    b = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, pos, out, have = 8 * len(data), 0, [], 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    strings, prev, full = list(base), None, False
    at, w = _AT[bits], _W[bits]
    while have < limit:
        if full:
            n = min(4096, (total - pos) // 12)
            off, width = pos + 12 * np.arange(n), 12
        else:
            n = int(np.searchsorted(at, total - pos, side="right")) - 1
            off, width = pos + at[:n], w[:n]
        if n <= 0:
            break
        i = off >> 3
        codes = (b[i] | b[i + 1] << 8 | b[i + 2] << 16) >> (off & 7) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stop[0]) if len(stop) else n
        part = codes[:k].tolist()
        got: list[bytes] = []
        put = got.append
        it = iter(part)
        if prev is None and part:
            c = next(it)
            if c >= clear:
                raise ValueError(f"first code {c}")
            prev = base[c]
            put(prev)
        grow = strings.append
        spare = 4096 - len(strings)
        for c in it:
            if spare <= 0:
                if c >= len(strings):
                    raise ValueError(f"code {c} beyond the table")
                put(strings[c])
                continue
            spare -= 1
            try:
                e = strings[c]
            except IndexError:
                if c != len(strings):
                    raise ValueError(f"code {c} beyond the table") from None
                e = prev + prev[:1]
            grow(prev + e[:1])
            put(e)
            prev = e
        piece = b"".join(got)
        out.append(piece)
        have += len(piece)
        if k < n and codes[k] == end:
            break
        if k < n:
            pos = int(off[k]) + (12 if full else int(w[k]))
            strings, prev, full = list(base), None, False
        else:
            pos, full = int(off[-1]) + (12 if full else int(w[n - 1])), True
    return b"".join(out)[:limit]


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF89a file of grey frames whose pixels are the payload's bytes; its length must be a multiple of width."""
    height = len(payload) // width
    if height * width != len(payload) or not height:
        raise ValueError("not whole rows")
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a" + struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0) + grey]
    for at in range(0, height, rows):
        part = payload[at * width : (at + rows) * width]
        stream = lzw_encode(part)
        out.append(b"!\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"," + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join(out) + b";"


def decode(data: bytes):
    """Yields (indices of the frame's own rectangle, canvas as height x width x 3 after drawing it, delay in ms, left,
    top, width, height). The canvas begins black, as viewers show an undrawn one on no background of its own."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    pos, palette = 13, None

    def colours(bits: int) -> np.ndarray:
        nonlocal pos
        n = 3 << (bits & 7) + 1
        if pos + n > len(data):
            raise ValueError("palette cut off")
        p = np.zeros((256, 3), np.uint8)
        p[: n // 3] = np.frombuffer(data, np.uint8, n, pos).reshape(-1, 3)
        pos += n
        return p

    def blocks() -> bytes:
        nonlocal pos
        parts = []
        while True:
            if pos >= len(data):
                raise ValueError("blocks cut off")
            n = data[pos]
            if pos + 1 + n > len(data):
                raise ValueError("block cut off")
            parts.append(data[pos + 1 : pos + 1 + n])
            pos += 1 + n
            if not n:
                return b"".join(parts)

    if flags & 0x80:
        palette = colours(flags)
    if h * w > MOST_PIXELS:
        raise ValueError(f"a canvas of {w} x {h}")
    canvas = np.zeros((h, w, 3), np.uint8)
    disposal, delay, clear_index = 0, 0, -1
    while True:
        if pos >= len(data):
            raise ValueError("no trailer")
        kind = data[pos]
        pos += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[pos] if pos < len(data) else -1
            pos += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = struct.unpack_from("<BHB", body)
                disposal, clear_index = f >> 2 & 7, t if f & 1 else -1
            continue
        if kind != 0x2C or pos + 10 > len(data):
            raise ValueError(f"unknown block {kind}")
        left, top, fw, fh, f = struct.unpack_from("<HHHHB", data, pos)
        pos += 9
        if fw * fh > MOST_PIXELS:
            raise ValueError(f"a frame of {fw} x {fh}")
        own = colours(f) if f & 0x80 else palette
        if own is None:
            raise ValueError("no palette")
        bits = data[pos] if pos < len(data) else 0
        pos += 1
        flat = np.frombuffer(lzw_decode(blocks(), bits, fw * fh), np.uint8)
        if len(flat) < fw * fh:
            raise ValueError("too few pixels")
        px = flat.reshape(fh, fw)
        if f & 0x40:
            order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            px = px[np.argsort(order, kind="stable")]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + fh, left : left + fw]
        shown = px[: area.shape[0], : area.shape[1]]
        if clear_index >= 0:
            mask = shown != clear_index
            area[mask] = own[shown[mask]]
        else:
            area[:] = own[shown]
        yield px, canvas, 10 * delay, left, top, fw, fh
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index = 0, 0, -1


def histogram(rgb: np.ndarray) -> list[int]:
    """Pixels by colour in 4 x 4 x 4 cells, red slowest."""
    cell = (rgb[..., 0] >> 6).astype(np.intp) * 16 + (rgb[..., 1] >> 6) * 4 + (rgb[..., 2] >> 6)
    return np.bincount(cell.ravel(), minlength=64).tolist()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds `out binary`, a GIF that holds the text's UTF-8 bytes, and `n_bytes`, their number before padding."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from .bpe import _map

    def fn(b):
        both = [padded(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        return [pa.array([encode(p) for _, p in both], pa.binary()), pa.array([n for n, _ in both], pa.int64())]

    return _map(df, [T.StructField(out, T.BinaryType()), T.StructField("n_bytes", T.LongType())], fn)


def frames(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """key, frame_no, at_ms (when it shows), delay_ms, width, height, rgb (the canvas), hist array<int> of 64 colour
    cells, error. A damaged file gives the frames before the damage, then a row with the error."""
    import pyarrow as pa

    schema = f"{key} {df.schema[key].dataType.simpleString()}, frame_no int, at_ms long, delay_ms int, width int, height int, rgb binary, hist array<int>, error string"
    names = [key, "frame_no", "at_ms", "delay_ms", "width", "height", "rgb", "hist", "error"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.string()]

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0), b.column(1).to_pylist()):
                if data is None:
                    continue
                at, no, error = 0, 0, None
                frame = decode(data)
                while True:
                    try:
                        _, canvas, delay, *_ = next(frame)
                        row = (no, at, delay, canvas.shape[1], canvas.shape[0], canvas.tobytes(), histogram(canvas), None)
                    except StopIteration:
                        break
                    except (ValueError, IndexError, struct.error) as e:
                        row = error = (no, None, None, None, None, None, None, str(e))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], k.type), *[pa.array([x], t) for x, t in zip(row, kinds)]], names=names)
                    if error:
                        break
                    at, no = at + delay, no + 1

    return df.select(key, media).mapInArrow(run, schema)


def payloads(df: DataFrame) -> DataFrame:
    """Reads columns doc_id, n_bytes, media back: digests of the stored bytes and of the file, and a feature string:
    number of frames, then the grey histogram in 16 cells over all frames."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                sha, size, cells, count, tail = hashlib.sha256(), 0, np.zeros(256, np.int64), 0, b""
                for px, canvas, *_ in decode(data):
                    part = px.tobytes()
                    sha.update(part)
                    size += len(part)
                    cells += np.bincount(canvas[: px.shape[0], :, 0].ravel(), minlength=256)
                    tail, count = part[-64:], count + 1
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"{count}:" + ",".join(map(str, cells.reshape(16, 16).sum(1).tolist()))))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def gif_frames(spark, sf_dir: str) -> DataFrame:
    """The timed frames of the documents' GIFs: doc_id, frame_no, at_ms, delay_ms, width, height, a digest of the canvas
    and its colour histogram."""
    small_batches(spark, 64)
    media = store(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")).select("doc_id", "media")
    return frames(media, "doc_id").select("doc_id", "frame_no", "at_ms", "delay_ms", "width", "height", F.sha2("rgb", 256).alias("rgb_sha256"), F.array_join("hist", ",").alias("hist"))


def op3_gif(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return payloads(store(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")))
