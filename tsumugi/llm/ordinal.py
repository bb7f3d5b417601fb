"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document gets one score, the sum of hashed-text weights shared by all grades; ordered thresholds t1 < t2 < ... turn it
into P(grade >= k) = sigmoid(score - t_k). The expected grade is the sum of these; selection uses the tail probability of
the best grade. Grades from the labels: 0 toxic, 1 of low quality, 2 good.

Features: presence of each word (lower case, outer marks off), and densities: the share of words of each shape (case and
last mark), of words equal to the one before, of lines equal to an earlier one. Words must occur in MIN_DOCS training
documents. Training is bounded: at most MAX_TRAIN labelled documents, chosen by hash of doc_id over all labels, whose
features (not texts) come to the driver. Everything is scored, on whole texts.

Null and empty texts have no words; they get the score of the bias alone plus an "empty" weight, and are never selected.
Labels that are null or without document are ignored; without two grades in the sample, every non-empty document is
kept with p_tail 1. Repeated rows score alike. Other columns are kept unless they bear an output's name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, written

DIM = 1 << 18
SHAPES = 64  # the last cells are for densities
SCALE = 20.0
MAX_TRAIN = 12_000
MIN_DOCS = 12
TAIL = 0.5
GRADES = 3
MARKS = b".,;:!?\"'()[]*#$%&|-"
ENDS = [b"!!", b"***", b"###", b"$$$", b"%%%", b"&&&", b"|", b"...", b"!", b"?", b",", b"."]
REPEAT, DUPLINE, EMPTY = DIM - 1, DIM - 2, DIM - 3


def word_cell(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.decode("utf-8", "replace").lower().encode().strip(MARKS), 7) % (DIM - SHAPES)


def shape_cell(word: bytes) -> int:
    end = next((i for i, e in enumerate(ENDS) if word.endswith(e)), len(ENDS))
    w = word.decode("utf-8", "replace")
    case = 0 if w.islower() else 1 if w.isupper() and len(w.strip("!.,")) > 1 else 2 if w[:1].isupper() else 3
    return DIM - SHAPES + case * (len(ENDS) + 1) + end


assert 4 * (len(ENDS) + 1) <= SHAPES - 4


def extras(words: list[bytes], raw: bytes) -> tuple[float, float]:
    """Shares of words equal to the one before, and of lines with a word that equal an earlier one."""
    n = max(1, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return sum(map(bytes.__eq__, words, words[1:])) / n, (len(lines) - len(set(lines))) / max(1, len(lines))


def features(text: str | None) -> tuple[list[int], list[float]]:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [EMPTY], [1.0]
    cells = {word_cell(w) for w in set(words)}
    shapes = Counter(map(shape_cell, words))
    rep, dup = extras(words, raw)
    idx = [*cells, *shapes, REPEAT, DUPLINE]
    return idx, [1.0] * len(cells) + [SCALE * c / len(words) for c in shapes.values()] + [SCALE * rep, SCALE * dup]


def fit(rows: list[tuple[list[int], list[float], int]], rounds: int = 120, l2: float = 1e-3, min_docs: int = MIN_DOCS, grades: int = GRADES):
    """(weights by cell, thresholds) by full-batch Adam on the cumulative-link likelihood; deterministic for given rows."""
    flat = np.concatenate([np.asarray(i, np.int32) for i, _, _ in rows])
    use = (np.bincount(flat, minlength=DIM) >= min_docs) | (np.arange(DIM) >= DIM - SHAPES)
    keep = use[flat]
    cols = (np.cumsum(use) - 1).astype(np.int32)[flat[keep]]
    vals = np.concatenate([np.asarray(v, np.float32) for _, v, _ in rows])[keep]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _, _ in rows])[keep]
    del flat, keep
    y = np.array([g for _, _, g in rows])
    d, n, m = int(use.sum()), len(rows), grades - 1
    # thresholds t_1 and the logs of the steps to the next, so that they stay ordered
    share = np.clip([(y < k).mean() for k in range(1, grades)], 0.01, 0.99)
    t = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), [t[0]], np.log(np.maximum(np.diff(t), 0.1))])
    mom, var = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for it in range(1, rounds + 1):
        w, steps = p[:d], np.exp(p[d + 1 :])
        t = p[d] + np.concatenate([[0], np.cumsum(steps)])
        s = np.bincount(row, w[cols] * vals, n)
        tail = np.column_stack([np.ones(n), *[sig(s - tk) for tk in t], np.zeros(n)])  # P(y >= k), k = 0 .. grades
        pk = np.maximum(tail[np.arange(n), y] - tail[np.arange(n), y + 1], 1e-12)
        slope = tail * (1 - tail)
        lo, hi = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        gs = -(lo - hi) / pk / n
        gt = np.zeros(m)
        for k in range(1, grades):
            gt[k - 1] = (slope[:, k] / pk * ((y == k).astype(float) - (y == k - 1))).sum() / n
        g = np.concatenate([np.bincount(cols, gs[row] * vals, d) + l2 * w, [gt.sum()], [gt[k:].sum() * steps[k - 1] for k in range(1, m)]])
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        p = p - 0.1 * (1 - it / (rounds + 1)) * (mom / (1 - 0.9**it)) / (np.sqrt(var / (1 - 0.99**it)) + 1e-8)
    weights = np.zeros(DIM)
    weights[use] = p[:d]
    return weights, p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> list[tuple[list[int], list[float], int]]:
    """Features and grades of at most `most` labelled documents, by the order of a hash of doc_id."""
    import pyarrow as pa

    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rows = labels.select(F.col("doc_id").cast("long"), grade.alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rows = written(rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most).drop("h"), "sample")

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(i, "<i4").tobytes() for i, _ in got], pa.binary()), pa.array([np.array(v, "<f4").tobytes() for _, v in got], pa.binary()), b.column(2)], names=["doc_id", "idx", "val", "grade"])

    some = docs.select(F.col("doc_id").cast("long"), "text").join(rows, "doc_id").select("doc_id", "text", "grade")
    got = some.mapInArrow(run, "doc_id long, idx binary, val binary, grade int").toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")  # each label once: the bound holds
    return [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"), g) for i, v, g in zip(got["idx"], got["val"], got["grade"].tolist())]


class Scorer:
    """Scores whole texts; weights per distinct word are cached, the cache is bounded."""

    def __init__(self, cells: np.ndarray, weights: np.ndarray, thresholds: list[float], cache: int = 500_000):
        self.of = dict(zip(cells.tolist(), weights.tolist()))
        self.t = thresholds
        self.word: dict[bytes, float] = {}
        self.shape: dict[bytes, float] = {}
        self.most = cache

    def score(self, text: str | None) -> float:
        raw = (text or "").encode()
        words = raw.split()
        get = self.of.get
        if not words:
            return get(EMPTY, 0.0)
        if len(self.word) > self.most:
            self.word.clear()
            self.shape.clear()
        distinct = set(words)
        for w in distinct.difference(self.word):
            self.word[w] = get(word_cell(w), 0.0)
            self.shape[w] = get(shape_cell(w), 0.0)
        # a cell counts once, however many words fall into it: only words with a weight need the look
        weighted = {word_cell(w) for w in distinct if self.word[w]}
        rep, dup = extras(words, raw)
        dense = sum(map(self.shape.__getitem__, words)) / len(words) + rep * get(REPEAT, 0.0) + dup * get(DUPLINE, 0.0)
        return sum(get(c) for c in sorted(weighted)) + SCALE * dense

    def tails(self, score: float) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(score - t, -40, 40)))) for t in self.t]


def scored(docs: DataFrame, model, tail: float = TAIL) -> DataFrame:
    """docs with score, expected_grade, p_tail (probability of the best grade) and kept."""
    import pyarrow as pa

    from .bpe import _map

    fields = [T.StructField("score", T.DoubleType()), T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    if model is None:
        blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
        return docs.drop(*[f.name for f in fields]).select("*", F.lit(0.0).alias("score"), F.lit(GRADES - 1.0).alias("expected_grade"), F.lit(1.0).alias("p_tail"), (~blank).alias("kept"))
    weights, thresholds = model
    cells = np.flatnonzero(weights)
    small = (cells.astype(np.int32), weights[cells].astype(np.float32), [float(t) for t in thresholds])  # at most DIM cells
    held: list[Scorer] = []

    def fn(b):
        if not held:
            held.append(Scorer(*small))
        rows = []
        for t in b.column(b.schema.get_field_index("text")).to_pylist():
            s = held[0].score(t)
            p = held[0].tails(s)
            rows.append((s, sum(p), p[-1], p[-1] >= tail and bool(t) and not re.fullmatch(r"[\x20\x09-\x0D]*", t)))
        cols = list(zip(*rows)) if rows else [()] * 4
        return [pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.float64(), pa.float64(), pa.bool_()))]

    return _map(docs, fields, fn)


def trained(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN):
    rows = sample(docs, labels, most)
    return fit(rows) if len({g for _, _, g in rows}) > 1 else None


def op10_ordinal(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels"))).select("doc_id", "score", "expected_grade", "p_tail", "kept")
