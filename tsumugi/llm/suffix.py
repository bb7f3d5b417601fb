"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts anywhere else.

A window of LENGTH bytes is known by its anchor, the least hash of the GRAM-byte strings in it; equal windows have equal
anchors. Windows in a row with one anchor make a snippet. Without losing a window, work shrinks in three steps:
anchors that occur once in all texts can't repeat; equal snippets are grouped with partial sums before the shuffle, so
a passage in a third of all documents is one row; where an anchor has several different snippets, they are aligned at it
and cut down to what the closest others share with them. What is still open goes, by anchor, into shards whose suffix
array and common prefixes are made by external induced sorting (`esais`): a window repeats exactly if its suffix shares
LENGTH bytes or more with a neighbour. Shards hold whole anchors and SHARD_BYTES or so. An anchor with more than
ANCHOR_BYTES of different snippets, as a line has that stands in many texts, is split before (`divided`): by where the
anchor stands in a window, and by the bytes that all windows with it there share.

`op9_suffix` reports LENGTH bytes, and in further columns PASSAGE bytes: 50 words of three letters and a space, the
least that a passage of over 50 words has. What repeats over LENGTH bytes lies within what repeats over PASSAGE bytes,
so the shorter length is looked for first and the longer one only within its runs.

Matches stay within documents and are judged on the input. Null and empty texts have no bytes. Documents shorter than
the length are left whole. Rows that repeat a doc_id with the same text are separate documents that cover each other.
Null doc_ids are allowed. Columns other than doc_id and text pass through `dedup` untouched, whatever their names. Texts
of any length are read in blocks; a block's edge splits a snippet but no window.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, free, new_folder, small_batches, table, written
from .esais import suffix_runs

LENGTH = 400
#: for passages of over 50 words, or 50 tokens, at 4 bytes a word with the space behind it
PASSAGE = 200
GRAM = 16
BLOCK_STARTS = 1 << 20
SHARD_BYTES = 8 << 20
ANCHOR_BYTES = 8 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of each GRAM-byte string."""
    a = np.frombuffer(raw, np.uint8)
    if len(a) < GRAM:
        return np.empty(0, np.uint64)
    u = np.lib.stride_tricks.as_strided(np.ascontiguousarray(a), (len(a) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    h = u[: len(a) - 15] * _M1
    h ^= h >> np.uint64(31)
    h += u[8:] * _M2
    h ^= h >> np.uint64(29)
    h *= _M1
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows, whether the anchor's hash stands in it twice) of each snippet of a text of at
    least `length` bytes."""
    h = gram_hashes(raw)
    w = length - GRAM + 1
    full = np.pad(h, (0, -len(h) % w), constant_values=np.uint64(2**64 - 1)).reshape(-1, w)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suf[: len(h) - w + 1], pre[w - 1 : len(h)])
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    v, n = low[at], np.diff(np.append(at, len(low)))
    # each place whose hash is the least of a window with it belongs to one snippet, and each snippet has such a place
    full = np.zeros(len(h) + w - 1 + -(len(h) + w - 1) % w, np.uint64)
    full[w - 1 : w - 1 + len(low)] = low
    full = full.reshape(-1, w)
    pre = np.maximum.accumulate(full, axis=1).ravel()
    suf = np.maximum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    if np.count_nonzero(np.maximum(suf[: len(h)], pre[w - 1 : w - 1 + len(h)]) == h) == len(at):
        return v, at, n, np.zeros(len(at), bool)
    twice = np.array([np.count_nonzero(h[a : a + k + w - 1] == x) > 1 for a, k, x in zip(at.tolist(), n.tolist(), v)], bool)
    return v, at, n, twice


def text_keys() -> tuple:
    """Two numbers that name a row's doc_id and text; equal rows share them. A null doc_id is none of the real ones."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """id and th (`text_keys`), base (place of the bytes in the text), raw (the text's bytes), doc_id."""
    one, two = text_keys()
    return docs.select(one.alias("id"), two.alias("th"), F.lit(0).alias("base"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.col("doc_id").cast("long").alias("doc_id"))


def snippets(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, id, th, base, start, n (windows), twice, h1, h2 (hash of the snippet's bytes), from `keyed` documents."""
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for row, raw in enumerate(b.column(3).to_numpy(zero_copy_only=False)):
                for base in range(0, len(raw) - length + 1, BLOCK_STARTS):
                    part = raw[base : base + BLOCK_STARTS + length - 1]
                    low, at, n, twice = anchors(part, length)
                    for c, x in zip(cols, (np.full(len(low), row), low.view(np.int64), at + base, n, twice)):
                        c.append(x)
                    cols[5].append(np.frombuffer(b"".join([xxh3_128_digest(part[i : i + k + length - 1]) for i, k in zip(at.tolist(), n.tolist())]), np.int64).reshape(-1, 2))
            if not cols[0]:
                continue
            row, low, at, n, twice, h = (np.concatenate(c) for c in cols)
            take = pa.array(row)
            own = [pa.array(low), *[b.column(i).take(take) for i in range(3)], pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(twice), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))]
            yield pa.RecordBatch.from_arrays(own, names=["anchor", "id", "th", "base", "start", "n", "twice", "h1", "h2"])

    return docs.select("id", "th", "base", "raw").mapInArrow(run, "anchor long, id long, th long, base int, start int, n int, twice boolean, h1 long, h2 long")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        m = (lo + hi + 1) // 2
        if a[:m] == b[:m]:
            lo = m
        else:
            hi = m - 1
    return lo


def _closest(parts: list[bytes]) -> list[int]:
    """For each the longest prefix that another begins with: its neighbours in sorted order have it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for a, b in zip(order, order[1:]):
        k = _common(parts[a], parts[b])
        best[a], best[b] = max(best[a], k), max(best[b], k)
    return best


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows at these sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def repeated(contents: list[tuple[bytes, int]], length: int = LENGTH, uri: str | None = None) -> list[np.ndarray]:
    """For each (bytes, times it occurs) the starts of windows that occur in another content, elsewhere in it, or, where
    it occurs more than once, all: by suffix array over all contents, 0 between them."""
    end = np.ones(1, np.uint16)
    t = np.concatenate([x for c, _ in contents for x in (np.frombuffer(c, np.uint8).astype(np.uint16) + np.uint16(2), end)])
    hit, last = np.zeros(len(t), bool), None
    for sa, lcp in suffix_runs(t, uri):  # both neighbours of a pair that shares enough
        near = np.flatnonzero(lcp >= length)
        hit[sa[near]] = True
        hit[sa[near[near > 0] - 1]] = True
        if len(near) and near[0] == 0 and last is not None:
            hit[last] = True
        last = int(sa[-1])
    out, at = [], 0
    for c, times in contents:
        k = max(0, len(c) - length + 1)
        out.append(np.arange(k) if times > 1 else np.flatnonzero(hit[at : at + k]))
        at += len(c) + 1
    return out


def resolve(rows: list[tuple[int, int, bytes]], length: int = LENGTH, uri: str | None = None) -> list[list[tuple[int, int]]]:
    """From (anchor, times, snippet) rows, all of each anchor: the bytes to remove of each snippet."""
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    groups: dict[int, list[int]] = {}
    for i, (anchor, _, _) in enumerate(rows):
        groups.setdefault(anchor, []).append(i)
    contents: dict[tuple[int, bytes], int] = {}
    members: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    open_keys: list[tuple[int, bytes]] = []
    for anchor, own in groups.items():
        offs = [np.flatnonzero(gram_hashes(rows[i][2]).view(np.int64) == anchor) for i in own]
        if all(len(o) == 1 for o in offs):
            off = [int(o[0]) for o in offs]
            right = _closest([rows[i][2][o:] for i, o in zip(own, off)])
            left = _closest([rows[i][2][:o][::-1] for i, o in zip(own, off)])
            parts = [(o - b, rows[i][2][o - b : o + a]) for i, o, a, b in zip(own, off, right, left)]
        else:  # the anchor's string repeats within a snippet: windows may match at other places, nothing is cut
            parts = [(0, rows[i][2]) for i in own]
        keys = []
        for i, (at, c) in zip(own, parts):
            if rows[i][1] > 1:
                out[i] = [(0, len(rows[i][2]))]
            if len(c) >= length:
                key = (anchor, c)
                if key not in contents:
                    keys.append(key)
                contents[key] = contents.get(key, 0) + rows[i][1]
                members.setdefault(key, []).append((i, at))
        aligned = all(len(o) == 1 for o in offs)
        if any(contents[k] == 1 for k in keys) and (len(keys) > 1 or not aligned):
            open_keys += keys
    hits = dict(zip(open_keys, repeated([(k[1], contents[k]) for k in open_keys], length, uri))) if open_keys else {}
    for key, who in members.items():
        starts = hits.get(key)
        if starts is None:
            if contents[key] < 2:
                continue
            starts = np.arange(len(key[1]) - length + 1)
        for i, at in who:
            if rows[i][1] == 1:
                out[i] = [(at + a, at + b) for a, b in _spans(starts, length)]
    return out


def resolved(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, h1, h2, spans from anchor, h1, h2, times, snippet; an anchor's rows meet in one task."""
    import pyarrow as pa

    spark = rows.sparkSession
    uri = new_folder(spark, "queues")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            spans = resolve([(a, n, s) for a, _, _, n, s in held], length, uri)
            some = [(r[0], r[1], r[2], [{"a": a, "b": b} for a, b in sp]) for r, sp in zip(held, spans) if sp]
            cols = list(zip(*some)) if some else [()] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], kind)], names=["anchor", "h1", "h2", "spans"])

        for b in batches:
            for r in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in b.columns]):
                if size >= SHARD_BYTES and r[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield flush()

    spread = rows.select("anchor", "h1", "h2", "times", "snippet").repartition(few, "anchor").sortWithinPartitions("anchor")
    return spread.mapInArrow(run, "anchor long, h1 long, h2 long, spans array<struct<a:int,b:int>>")


def halves(part: bytes, at: int, lo: int, hi: int, a: int, b: int, length: int) -> list[tuple]:
    """A piece is the windows of a snippet with a to b - 1 bytes before their first anchor, `part` the bytes from `at` of
    the snippet that they cover. For both halves of lo..hi that have windows of it: (two hashes of the bytes that all
    windows of the half share, two of the piece's own bytes, lo, hi, a, b, at, part)."""
    from xxhash import xxh3_128_digest

    out, mid = [], (lo + hi) // 2
    for x, y in ((lo, mid), (mid, hi)):
        c, d = max(a, x), min(b, y)
        if c < d:
            skip = b - d
            own = part[skip : len(part) - (c - a)]
            core = part[b - 1 - x : b - 1 + length - y + 1]
            keys = np.frombuffer(xxh3_128_digest(b"%d %d " % (x, y) + core) + xxh3_128_digest(b"%d %d " % (c, d) + own), np.int64).tolist()
            out.append((*keys, x, y, c, d, at + skip, own))
    return out


def pieces(raw: bytes, anchor: int, length: int) -> list[tuple]:
    """The halves of 0..length - GRAM + 1 of all pieces of a snippet, one piece for each place of its anchor."""
    out, before = [], -1
    for p in np.flatnonzero(gram_hashes(raw).view(np.int64) == anchor).tolist():
        a, b = max(0, p + length - len(raw)), min(p - before - 1, length - GRAM) + 1
        if a < b:
            at = p - b + 1
            out += halves(raw[at : p - a + length], at, 0, length - GRAM + 1, a, b, length)
        before = p
    return out


_PIECE = ["c1", "c2", "u1", "u2", "lo", "hi", "a", "b", "at", "part"]
_ROW = "anchor long, h1 long, h2 long, times long, c1 long, c2 long, u1 long, u2 long, lo int, hi int, a int, b int, at int, part binary"


def divided(rows: DataFrame, length: int = LENGTH, most: int = ANCHOR_BYTES) -> DataFrame:
    """As `resolved`, an anchor's rows in many tasks; a snippet can have several rows of spans. Equal windows have their
    first anchor at the same place, so they are in the same half of the places and share what all windows of that half
    cover. Groups of pieces that share it stay together; equal pieces become one row with partial sums, a group of one
    row ends, one of up to `most` bytes goes to the sorter, a larger one is halved again. A half of one place is a window
    and its group one row, so no group stays larger."""
    import pyarrow as pa

    spark = rows.sparkSession
    uri = new_folder(spark, "queues")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    ids = ["anchor", "h1", "h2"]
    types = [*[pa.int64()] * 8, *[pa.int32()] * 5, pa.binary()]
    names = [*ids, "times", *_PIECE]

    def table_of(out):
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def begin(batches):
        for b in batches:
            out = []
            for anchor, h1, h2, times, raw in zip(*[c.to_pylist() for c in b.columns]):
                for x in pieces(raw, anchor, length):
                    out.append((anchor, h1, h2, times, *x))
                    if len(out) >= 20_000:
                        yield table_of(out)
                        out = []
            yield table_of(out)

    def halve(batches):
        for b in batches:
            yield table_of([(*r[:4], *x) for r in zip(*[c.to_pylist() for c in b.columns]) for x in halves(r[9], r[8], *r[4:8], length)])

    def sort(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            hits = repeated([(r[7], r[3]) for r in held], length, uri)
            some = [(*r[:3], [{"a": a + r[6], "b": b + r[6]} for a, b in _spans(x, length)]) for r, x in zip(held, hits) if len(x)]
            cols = list(zip(*some)) if some else [()] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], kind)], names=[*ids, "spans"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if size >= SHARD_BYTES and r[4:6] != held[-1][4:6]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[7])
        if held:
            yield flush()

    spans_kind = "anchor long, h1 long, h2 long, spans array<struct<a:int,b:int>>"
    one_span = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))).alias("spans")
    found = [rows.filter("times > 1").select(*ids, one_span(F.lit(0), F.length("snippet")))]
    level = rows.select(*ids, "times", "snippet").repartition(few, *ids).mapInArrow(begin, _ROW)
    while True:
        level = written(level, "pieces")
        keys = ["anchor", "c1", "c2", "u1", "u2"]
        kinds = level.groupBy(*keys).agg(F.sum("times").alias("total"), F.first(F.struct("h1", "h2", "lo", "hi", "a", "b", "at", "part")).alias("one"))
        kinds = written(kinds, "kinds")
        equal = level.filter("times = 1").join(kinds.filter("total > 1").select(*keys), keys)
        found.append(written(equal.select(*ids, one_span(F.col("at"), F.col("at") + F.col("b") - F.col("a") + (length - 1))), "spans"))
        groups = kinds.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("c"), F.min("total").alias("least"), F.sum(F.length("one.part")).alias("bytes"))
        groups = written(groups.filter("c > 1 AND least = 1").select("anchor", "c1", "c2", (F.col("bytes") > most).alias("large")), "groups")
        kinds = kinds.join(groups, ["anchor", "c1", "c2"])
        small = kinds.filter("NOT large").select("anchor", "one.h1", "one.h2", "total", "c1", "c2", "one.at", "one.part")
        found.append(written(small.repartition(few, "c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(sort, spans_kind), "spans"))
        if not groups.filter("large").limit(1).count():
            break
        rest = kinds.filter("large").select("anchor", "one.h1", "one.h2", "total", "one.lo", "one.hi", "one.a", "one.b", "one.at", "one.part")
        level = rest.repartition(few, "h1", "h2", "at").mapInArrow(halve, _ROW)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cut(keyed_docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, th, spans array<struct<a,b>>: bytes to remove of each text that has any, not merged."""
    import pyarrow as pa

    whole = ["id", "th", "base"]
    occ = written(snippets(keyed_docs, length), "snippets")
    # do rows repeat as a whole? then a text's first snippet stands twice at one place
    rows_repeat = bool(occ.filter("start = 0").groupBy(*whole).agg(F.count("*").alias("c")).filter("c > 1").limit(1).count())
    rep = written(occ.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).filter("c > 1 OR twice").select("anchor"), "anchors")
    hits = written(occ.join(rep, "anchor", "left_semi"), "hits")
    drop_tables(occ, rep)
    kinds = hits.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("id", "th", "base", "start", "n")).alias("one"), F.max("twice").alias("twice"))
    kinds = written(kinds, "kinds")
    many = written(kinds.groupBy("anchor").agg(F.count("*").alias("c"), F.max(F.col("twice") & (F.col("times") == 1)).alias("t"), F.sum(F.col("one.n") + (length - 1)).alias("bytes")).filter("c > 1 OR t").select("anchor", "bytes"), "anchors")
    large = many.filter(F.col("bytes") > ANCHOR_BYTES).select("anchor")
    alone = kinds.join(many, "anchor", "left_anti").select("anchor", "h1", "h2", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.n") + (length - 1)).cast("int").alias("b"))).alias("spans"))
    wanted = kinds.join(many, "anchor", "left_semi").select("one.id", "one.th", "one.base", F.struct("anchor", "h1", "h2", "times", F.col("one.start").alias("start"), F.col("one.n").alias("n")).alias("w"))
    wanted = wanted.groupBy(*whole).agg(F.collect_list("w").alias("w"))  # no more than the text has snippets

    def pick(batches):
        for b in batches:
            raws, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.flatten()
            cols = [flat.field(i) for i in range(6)]
            start, n = cols[4].to_numpy().tolist(), cols[5].to_numpy().tolist()
            first = int(ends[0])
            out = [raw[start[k] : start[k] + n[k] + length - 1] for raw, x, y in zip(raws, ends, ends[1:]) for k in range(int(x) - first, int(y) - first)]
            yield pa.RecordBatch.from_arrays([*cols[:4], pa.array(out, pa.binary())], names=["anchor", "h1", "h2", "times", "snippet"])

    texts = keyed_docs.select(*whole, "raw").filter(F.octet_length("raw") >= length).join(wanted, whole)
    texts = texts.dropDuplicates(whole) if rows_repeat else texts
    open_ = texts.select("raw", "w").mapInArrow(pick, "anchor long, h1 long, h2 long, times long, snippet binary")
    if large.limit(1).count():
        open_ = written(open_, "open")
        done = resolved(open_.join(large, "anchor", "left_anti"), length).unionByName(divided(open_.join(large, "anchor", "left_semi"), length, ANCHOR_BYTES))
    else:
        done = resolved(open_, length)
    spans = written(alone.unionByName(done), "spans")
    drop_tables(kinds, many)
    at = F.col("start") + F.col("base")
    per = hits.join(spans, ["anchor", "h1", "h2"]).select("id", "th", F.transform("spans", lambda s: F.struct((s.a + at).alias("a"), (s.b + at).alias("b"))).alias("s"))
    return per.groupBy("id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _pairs(col) -> list[list[tuple[int, int]]]:
    """(a, b) lists of an Arrow column of spans; null: none."""
    ends = col.offsets.to_numpy()
    flat = col.flatten()
    both = list(zip(flat.field(0).to_numpy().tolist(), flat.field(1).to_numpy().tolist()))
    null = col.is_null().to_numpy(zero_copy_only=False).tolist() if col.null_count else [False] * len(col)
    out, at = [], 0
    for gone, x, y in zip(null, ends.tolist(), ends[1:].tolist()):
        k = 0 if gone else y - x
        out.append(both[at : at + k])
        at += k
    return out


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in spans]]
    return b"".join(raw[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(raw)]))


_SPANS = "spans array<struct<a:int,b:int>>"


def runs(keyed_docs: DataFrame, length: int) -> DataFrame:
    """id, th, spans: the maximal removed runs of each text that has any, in order; a written table."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        for b in batches:
            got = [[{"a": x, "b": y} for x, y in merged(p)] for p in _pairs(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, kind)], names=["id", "th", "spans"])

    return written(cut(keyed_docs, length).mapInArrow(run, "id long, th long, " + _SPANS), "runs")


def within(keyed_docs: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """What can repeat over `length` bytes, as rows like keyed_docs: a repeated string is covered by repeated shorter
    ones, so it lies within one of their runs."""
    import pyarrow as pa

    long = shorter.withColumn("spans", F.filter("spans", lambda s: s.b - s.a >= length)).filter(F.size("spans") > 0)

    def run(batches):
        for b in batches:
            raws, spans = b.column(2).to_numpy(zero_copy_only=False), _pairs(b.column(3))
            take = pa.array([i for i, p in enumerate(spans) for _ in p], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([x for p in spans for x, _ in p], pa.int32()), pa.array([raw[x:y] for raw, p in zip(raws, spans) for x, y in p], pa.binary())], names=["id", "th", "base", "raw"])

    both = keyed_docs.select("id", "th", "raw").join(long, ["id", "th"])
    return written(both.mapInArrow(run, "id long, th long, base int, raw binary"), "within")


def digests(docs: DataFrame, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. With `shorter` also passage_removed and passage_spans, as
    n_removed and n_spans for that length; strings of `length` bytes are then looked for within those runs."""
    import pyarrow as pa

    docs = keyed(docs)
    found = [runs(docs, shorter)] if shorter else []
    found.insert(0, runs(within(docs, found[0], length) if shorter else docs, length))
    both = docs
    for k, f in enumerate(found):
        both = both.join(f.withColumnRenamed("spans", f"spans{k}"), ["id", "th"], "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["passage_removed", "passage_spans"] * bool(shorter)]

    def run(batches):
        for b in batches:
            cols = [b.column(0), [], [], [], [], [], []]
            longer = _pairs(b.column(2))
            short = _pairs(b.column(3)) if shorter else longer
            for raw, m, s in zip(b.column(1).to_numpy(zero_copy_only=False), longer, short):
                row = (len(raw), sum(y - x for x, y in m), len(m), hashlib.sha256(keep(raw, m)).hexdigest(), sum(y - x for x, y in s), len(s))
                for c, x in zip(cols[1:], row):
                    c.append(x)
            kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in list(zip(cols, kinds))[: len(names)]], names=names)

    out = both.select("doc_id", "raw", *[f"spans{k}" for k in range(len(found))])
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", passage_removed long, passage_spans long" * bool(shorter))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the covered bytes taken out of column text; a character that a cut splits is dropped."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from .bpe import _map

    one, two, sp = free(docs, "one", "two", "spans")
    k1, k2 = text_keys()
    cuts = cut(keyed(docs), length).select(F.col("id").alias(one), F.col("th").alias(two), F.col("spans").alias(sp))
    both = docs.withColumns({one: k1, two: k2}).join(cuts, [one, two], "left")

    def fn(b):
        texts, spans = b.column(b.schema.get_field_index("text")).to_pylist(), _pairs(b.column(b.schema.get_field_index(sp)))
        return [pa.array([keep(t.encode(), merged(s)).decode("utf-8", "ignore") if t and s else t for t, s in zip(texts, spans)], pa.string())]

    return _map(both, [T.StructField("text", T.StringType())], fn).select(*docs.columns)


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"), LENGTH, PASSAGE)
