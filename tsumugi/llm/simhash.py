"""SimHash near-duplicates: byte-position inverted index with count filtering.

Documents with equal fingerprints form a class at once. Two 64-bit fingerprints at 4 or fewer differing bits differ in at
most 4 bytes, so at least 4 of the 8 (position, byte) postings are shared: the guaranteed minimum. Lists of single
postings hold 1/256 of all fingerprints each, whose pairs would be all pairs again; so the index is kept on triples of
positions. Of the 56 triples a family of 20 suffices: every set of 4 positions contains one of them (a Turan system on 3
groups of positions). A pair that meets in a list gets its tally of shared positional bytes, is dropped below 4, and is
verified by its differing bits; it is counted only in the first list of the family that both are in, so no pair counts
twice and no pair table is shuffled. Tasks return each fingerprint's number of linked documents and a spanning forest of
each list's links, never all pairs; components follow from the forests.

A list with more than HOT fingerprints is cut into blocks, and each pair of blocks is a task of its own, so a crowd of
near copies is spread without loss. Null and empty texts have no words and fingerprint zero, linked like any other.
Repeated rows are documents of their own in n_near and share component_id. Null doc_ids are left out of the minimum,
and component_id is null where a component has no other. `dedup` keeps one row of each component, also of those; rows
that share a doc_id but aren't linked stay. An empty table gives no rows. Columns other than doc_id and text aren't read
by `near`; `dedup` keeps all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, small_batches, table, written
from .graph import components

SHINGLE = 4
MAX_BITS = 4
HOT = 4096
CHUNK_ROWS = 200_000
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def family() -> list[tuple[int, ...]]:
    """20 triples of the 8 positions such that any 4 positions contain one: those within a group, and those with two
    positions in a group and one in the next."""
    out = []
    for i, g in enumerate(_GROUPS):
        out += list(combinations(g, 3))
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in _GROUPS[(i + 1) % 3]]
    return out


FAMILY = family()
#: by the bit mask of equal positions: the first triple of the family within it, or 255
FIRST = np.array([next((k for k, t in enumerate(FAMILY) if all(m >> p & 1 for p in t)), 255) for m in range(256)], np.uint8)


def fingerprint(text: str | None) -> int:
    """64 bits of a text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    # bytes.lower changes A-Z only, bytes.split knows the same six white-space characters as the word pattern
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(part), 255):
            counts += bits[i : i + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and if `hashed` th, another hash of the text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    more = [F.xxhash64("text").alias("th")] if hashed else []
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, "doc_id long, fp long" + ", th long" * hashed)


def postings(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """key (triple of the family and its three bytes), tile, block, fp, n: a row per fingerprint and triple, and for
    lists above `hot` a row for each pair of blocks that the fingerprint's block is in."""
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(255) for p in range(8)]
    keys = F.array(*[(F.lit(k * 2**24) + byte[a] * 65536 + byte[b] * 256 + byte[c]).cast("int") for k, (a, b, c) in enumerate(FAMILY)])
    rows = classes.select("fp", "n", F.explode(keys).alias("key"))
    big = written(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > hot), "hot")
    rows = rows.join(big, "key", "left").withColumn("blocks", F.when(F.col("m").isNull(), 1).otherwise(F.ceil(F.col("m") / hot)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).cast("int").alias("tile"), (F.col("block") == F.col("other")).alias("own"), F.when(F.col("block") < F.col("other"), 0).when(F.col("block") > F.col("other"), 1).otherwise(0).cast("int").alias("side"), "fp", "n")


def _pairs(key: np.ndarray, tile: np.ndarray, own: np.ndarray, side: np.ndarray, fp: np.ndarray, n: np.ndarray, max_bits: int):
    """(links counted per row, forest edges as row pairs) of whole lists, rows sorted by key and tile."""
    rows = len(key)
    near, label = np.zeros(rows, np.int64), np.arange(rows)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def join_up():
        nonlocal held, size
        if held:
            i, j = (np.concatenate(x) for x in zip(*held))
            while True:
                a, b = label[i], label[j]
                m = a != b
                if not m.any():
                    break
                i, j, a, b = i[m], j[m], a[m], b[m]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label[:] = up
            held, size = [], 0

    d, triple = 1, (key >> 24).astype(np.uint8)
    at = np.arange(rows - 1)
    while True:
        at = at[at + d < rows]
        at = at[(key[at] == key[at + d]) & (tile[at] == tile[at + d])]
        if not len(at):
            break
        i = at[own[at] | (side[at] != side[at + d])]  # in a tile of two blocks only pairs across
        x = fp[i] ^ fp[i + d]
        same = np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()
        # count filter, then verification
        ok = (np.bitwise_count(same) >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)
        i, same = i[ok], same[ok]
        if len(i):
            held.append((i, i + d))
            size += len(i)
            c = i[FIRST[same] == triple[i]]
            near += np.bincount(c, n[c + d], rows).astype(np.int64) + np.bincount(c + d, n[c], rows).astype(np.int64)
            if size > 500_000:
                join_up()
        d += 1
    join_up()
    j = np.flatnonzero(label != np.arange(rows))
    return near, j, label[j]


def links(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From postings: fp, other (an edge of a list's spanning forest, or null), near (documents newly counted)."""
    import pyarrow as pa

    if not 0 <= max_bits <= 4:
        raise ValueError("the family of triples guarantees up to 4 differing bits")

    def run(batches):
        rest = None

        def emit(a):
            near, i, j = _pairs(a["key"], a["tile"], a["own"], a["side"], a["fp"], a["n"], max_bits)
            k = np.flatnonzero(near)
            fps = a["fp"].view(np.int64)
            one = pa.array(np.concatenate([fps[k], fps[i]]))
            two = pa.array(np.concatenate([np.zeros(len(k), np.int64), fps[j]]), mask=np.concatenate([np.ones(len(k), bool), np.zeros(len(i), bool)]))
            return pa.RecordBatch.from_arrays([one, two, pa.array(np.concatenate([near[k], np.zeros(len(i), np.int64)]))], names=["fp", "other", "near"])

        for b in batches:
            a = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in b.schema.names}
            a["fp"] = a["fp"].view(np.uint64)
            if rest is not None:
                a = {c: np.concatenate([rest[c], a[c]]) for c in a}
            change = np.flatnonzero((a["key"][1:] != a["key"][:-1]) | (a["tile"][1:] != a["tile"][:-1]))
            if len(a["key"]) < CHUNK_ROWS or not len(change):
                rest = a
                continue
            cut = change[-1] + 1
            yield emit({c: v[:cut] for c, v in a.items()})
            rest = {c: v[cut:] for c, v in a.items()}
        if rest is not None and len(rest["key"]):
            yield emit(rest)

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "key", "tile").sortWithinPartitions("key", "tile").mapInArrow(run, "fp long, other long, near long")


def linked(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """fp, n_near, component_id, root (which names the component) of each fingerprint."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = written(links(postings(classes, hot), max_bits), "links")
    roots = components(found.filter("other IS NOT NULL").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    counted = found.filter("other IS NULL").groupBy("fp").agg(F.sum("near").alias("near"))
    per = classes.join(roots, classes.fp == roots.node, "left").join(counted, "fp", "left").select("fp", "n", "rep", "near", F.coalesce("root", "fp").alias("root"))
    per = written(per, "members")
    low = per.groupBy("root").agg(F.min("rep").alias("component_id"))
    return written(per.join(low, "root").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_near"), "component_id", "root"), "classes")


def near(docs: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, fp, n_near (other documents linked directly), component_id (smallest doc_id reachable), all rows."""
    fps = written(fingerprints(docs), "fingerprints")
    return fps.join(linked(fps, max_bits, hot), "fp").select("doc_id", "fp", "n_near", "component_id")


def dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the least by doc_id, nulls last, then by hash of the text; of rows with both equal, one."""
    one, two, own = free(docs, "one", "two", "own")
    fps = written(fingerprints(docs, hashed=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    keep = fps.join(linked(fps, max_bits), "fp").groupBy("root").agg(first).select(F.col("first.doc_id").alias(one), F.col("first.th").alias(two))
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(own) == F.col(two)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    got = near(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
