"""Substring dedup: sliding sentence spans.

A text is cut into sentences, after . ! ? before white space and at line ends. The query takes the shortest span of
MIN_WORDS words or more from each sentence and the shortest that ends at each, of one sentence or several; a text of
fewer words is one span. So every sentence of a later copy is covered, of a text or of a passage of MIN_WORDS words or
more: those near its end by the spans that end there. `dedup` without `whole` has spans from each sentence only, of
MIN_SENTENCES sentences or more; it leaves last sentences that don't fill one, and single sentences. Spans are hashed to
128 bits and joined over all documents; every sentence covered by a repeated span that isn't its first occurrence, by
doc_id and place, is removed; with `whole`, white space goes too where no sentence is left.

Partial minima precede the first shuffle, so a span in a third of all documents is one row per task; the join back with
its occurrences is split by the skew join. Null and empty texts have no sentences, and texts without a word no span:
they stay as they are. Rows that share doc_id and text are one document: they stay or go together. Rows that share only
the doc_id are documents of their own, in the order of a hash of their texts. Rows without doc_id are kept whole and
remove nothing. Other columns pass through `dedup`, whatever their names. White space between sentences stays with the
sentence before.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, small_batches, table, written

MIN_SENTENCES = 2
MIN_WORDS = 12
BREAK = re.compile(r"(?<=[.!?])(?=[ \t\r\x0b\x0c])[ \t\r\x0b\x0c]+|(?<=\n)")


def sentences(text: str) -> list[str]:
    """Parts that make up the text; each ends after the white space behind its last mark, or after a line's end."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if m.end() > at:
            out.append(text[at : m.end()])
            at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def spans(parts: list[str]) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, hash) of each span: white space within and around sentences doesn't count, sentences
    without a word belong to no count."""
    from xxhash import xxh3_128_digest

    words = [p.split() for p in parts]
    sizes = [len(w) for w in words]
    flat = [" ".join(w) for w in words]
    real = [i for i, n in enumerate(sizes) if n]
    out, hi, total = [], 0, 0
    for lo, i in enumerate(real):
        while hi < len(real) and (total < MIN_WORDS or hi - lo < MIN_SENTENCES):
            total += sizes[real[hi]]
            hi += 1
        if total < MIN_WORDS or hi - lo < MIN_SENTENCES:
            break
        out.append((i, real[hi - 1] - i + 1, xxh3_128_digest("\n".join([flat[j] for j in real[lo:hi]]))))
        total -= sizes[i]
    return out


def whole_spans(parts: list[str]) -> list[tuple[int, int, bytes]]:
    """As `spans`: the shortest of MIN_WORDS words from each sentence and to each, or all of a text of fewer words."""
    from xxhash import xxh3_128_digest

    words = [p.split() for p in parts]
    real = [i for i, w in enumerate(words) if w]
    sizes = [len(words[i]) for i in real]
    flat = [" ".join(words[i]) for i in real]
    runs, lo, total = set(), 0, 0
    for hi, n in enumerate(sizes, 1):
        total += n
        while total >= MIN_WORDS:
            runs.add((lo, hi))
            total -= sizes[lo]
            lo += 1
    hi, total = len(sizes), 0
    for lo in range(len(sizes) - 1, -1, -1):
        total += sizes[lo]
        while total >= MIN_WORDS:
            runs.add((lo, hi))
            hi -= 1
            total -= sizes[hi]
    if real and not runs:
        runs.add((0, len(real)))
    return [(real[a], real[b - 1] - real[a] + 1, xxh3_128_digest("\n".join(flat[a:b]))) for a, b in sorted(runs)]


def occurrences(docs: DataFrame, whole: bool = False) -> DataFrame:
    """h1, h2, doc_id, th (a hash of the text), pos, n of every span."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows, ids = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                got = (whole_spans if whole else spans)(sentences(t))
                rows += got
                ids.append(np.full(len(got), k))
            if rows:
                pos, n, h = zip(*rows)
                h, take = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2), pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column(0).take(take), b.column(1).take(take), pa.array(pos, pa.int32()), pa.array(n, pa.int32())], names=["h1", "h2", "doc_id", "th", "pos", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, th long, pos int, n int")


def covered(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, th, gone array<struct<pos,n>>: runs of sentences to remove, of documents that have any."""
    occ = written(occurrences(docs, whole), "spans")
    place = F.struct("doc_id", "th", "pos")
    first = occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = written(first.filter("first <> last").select("h1", "h2", "first"), "repeated")
    later = occ.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))


def _strip(docs: DataFrame, n: str, m: str, whole: bool = False) -> DataFrame:
    """docs with kept text; columns n and m: the text's sentences and those removed."""
    import pyarrow as pa

    from .bpe import _map

    one, two, runs = free(docs, "one", "two", "runs")
    gone = covered(docs, whole).select(F.col("doc_id").alias(one), F.col("th").alias(two), F.col("gone").alias(runs))
    both = docs.withColumn(two, F.xxhash64("text")).join(gone.withColumnRenamed(two, two + "_"), (F.col("doc_id").cast("long") == F.col(one)) & (F.col(two) == F.col(two + "_")), "left").drop(one, two, two + "_")

    def fn(b):
        rows = []
        for t, g in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index(runs)).to_pylist()):
            parts = sentences(t or "")
            out = {i for s in g or [] for i in range(s["pos"], s["pos"] + s["n"])}
            if whole and out and all(i in out or not p.split() for i, p in enumerate(parts)):
                out = set(range(len(parts)))
            rows.append((t if not out else "".join([p for i, p in enumerate(parts) if i not in out]), len(parts), len(out)))
        cols = list(zip(*rows)) if rows else [()] * 3
        return [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))]

    return _map(both, [T.StructField("text", T.StringType()), T.StructField(n, T.LongType()), T.StructField(m, T.LongType())], fn)


def dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    return _strip(docs, *free(docs, "n_sentences", "n_removed"), whole).select(*docs.columns)


def op6_spans(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    got = _strip(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), "n_sentences", "n_removed", whole=True)
    return got.select("doc_id", "n_sentences", "n_removed", "text")
