"""Quality rules: risk-controlled thresholds.

A base check (too few words, too many repeated windows) and a set of metrics on which junk scores high. For each stratum
(language) and metric a cutoff is chosen on labelled holdout rows: over a fixed grid, from the laxest cutoff down, the
hypothesis "this cutoff rejects more than `risk` of good documents" is tested with the exact binomial tail; the last
cutoff before the first hypothesis that stands is taken. Such a chain in fixed order needs no correction of its own; over
chains the level is divided by their number, and a chain whose hypotheses have all fallen passes its share on to the
others, in equal parts (Holm's rule, for chains). With probability 1 - level, no chosen cutoff rejects more than `risk`
of its stratum's good documents. RISK = 0.02 is two good documents in a hundred for a rule.

Strata with too few good labels for any cutoff (fewer than log(share of the level) / log(1 - risk): 316 with 30 chains)
are judged as one, POOLED, with chains of its own; which these are depends on numbers of labels alone. Its guarantee is
for the pooled strata together. If they have too few labels even so, the labels of all strata make up the pool, and what
is guaranteed holds for all documents together. Languages without labels take the pooled cutoffs too. Where all labels
are too few, there is no cutoff, and documents pass.

All labelled rows and all documents count. Text is read once, into a narrow written table of counts; histograms are
summed before the shuffle, and the tests run on one row per stratum, metric and grid cell. Null text counts as empty: no
words, which fails the base check. A null language is a stratum of its own. Labels that are null or whose doc_id is
unknown are ignored; repeated labels count each. Repeated rows are kept. Columns beyond doc_id, text, lang aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

RISK = 0.02
LEVEL = 0.05
SYMBOLS = b"#*$%&|<>"
#: metric: (numerator, denominator) over the columns of `counts`, and the step of its grid of cutoffs from 0 to 1
METRICS = {
    "symbol": ("n_symbols", "word_chars", 0.005),
    "shout": ("n_upper", "word_chars", 0.01),
    "mark": ("n_marked", "n_words", 0.01),
    "line": ("n_dup_lines", "n_lines", 0.02),
    "repeat": ("n_repeat_words", "n_words", 0.005),
    "stutter": ("n_stutter", "n_words", 0.005),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marked", "n_stutter"]


def count(text: str | None) -> tuple[int, ...]:
    """The columns COUNTS of a text. Words are runs without the six ASCII white-space characters, which bytes.split
    knows as such; UTF-8 keeps all other characters whole."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():  # bytes.isspace knows the same six characters
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            times: dict[tuple, int] = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeat += i + 5 - max(i, end)
                    end = i + 5
    lower = joined.decode().lower()
    upper = sum(map(str.isupper, joined.decode())) if lower != joined.decode() else 0
    marked = sum(1 for w in words if w[-1] in b"!|*#$%&")
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return n, chars, symbols, dup, repeat, lines, upper, marked, stutter


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the columns COUNTS, one row per document."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [count(t) for t in b.column(2).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "lang", *COUNTS])

    some = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    return some.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metric(name: str) -> F.Column:
    top, bottom, _ = METRICS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def log_tail(n: int, k: int, p: float) -> float:
    """log P(X <= k) for X binomial(n, p), by the exact sum."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def lowest_safe(cells: dict[int, int], risk: float, level: float) -> int | None:
    """cells: good holdout documents by grid cell; cutting at c rejects the cells above c. The lowest cutoff that
    fixed-order testing from the highest cell down allows; None if not even the first is shown to be safe."""
    n, above, best = sum(cells.values()), 0, None
    for c in sorted(cells, reverse=True):
        # nothing lies between this cell and the last one tested: one test covers all cutoffs in between
        if n == 0 or log_tail(n, above, risk) > math.log(level):
            break
        best = c
        above += cells[c]
    return best


def chain(cells: dict[int, int], risk: float, level: float) -> list[tuple[int, float]]:
    """(cutoff cell, log of the level that cutting there needs), from the highest cell down, as far as `level` could ever
    go; what a cutoff needs includes what those before it need."""
    n, above, most, out = sum(cells.values()), 0, -math.inf, []
    for c in sorted(cells, reverse=True):
        most = max(most, log_tail(n, above, risk))
        out.append((c, most))
        if most > math.log(level):
            break
        above += cells[c]
    return out


def least_labels(chains: int, risk: float, level: float) -> int:
    """Good labels that the laxest cutoff needs with a `chains`-th part of the level."""
    return math.ceil(math.log(level / chains) / math.log1p(-risk))


POOLED = "pooled"


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, pooled (true: the one for all other strata), metric, cutoff (a document with a metric above it is
    rejected; null: none), n_good. `stats` has the columns of `counts`; labels (doc_id, quality, toxic)."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.ceil(metric(m) / step).cast("int").alias("cell"), F.lit(step).alias("step")) for m, (_, _, step) in METRICS.items()])
    hist = stats.filter(~base_failed()).join(good, "doc_id").select(F.col("lang").alias("stratum"), F.explode(cells).alias("c")).groupBy("stratum", "c.metric", "c.cell", "c.step").agg(F.count("*").alias("n"))
    hist = written(hist, "histograms")
    per = hist.groupBy("stratum").agg((F.sum("n") / len(METRICS)).alias("good"))
    least = least_labels(max(1, (per.count() + 1) * len(METRICS)), risk, level)
    small = per.filter(F.col("good") < least).select(F.col("stratum").alias("s"))
    both = hist.join(small, F.col("stratum").eqNullSafe(F.col("s")), "left_anti").withColumn("pooled", F.lit(False))
    own = per.filter(F.col("good") < least).agg(F.coalesce(F.sum("good"), F.lit(0))).first()[0]
    pool = hist.join(small, F.col("stratum").eqNullSafe(F.col("s")), "left_semi") if own == 0 or own >= least else hist
    pool = pool.groupBy("metric", "cell", "step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("stratum"), "metric", "cell", "step", "n", F.lit(True).alias("pooled"))
    schema = "stratum string, pooled boolean, metric string, cutoff double, needs double, last boolean, n_good long"

    def run(pdf):
        import pandas as pd

        first, steps = pdf.iloc[0], chain(dict(zip(pdf["cell"].tolist(), pdf["n"].tolist())), risk, level)
        cut = [c * first["step"] for c, _ in steps]
        last = len(steps) == len(pdf)
        return pd.DataFrame({"stratum": first["stratum"], "pooled": first["pooled"], "metric": first["metric"], "cutoff": cut, "needs": [x for _, x in steps], "last": [last and i == len(steps) - 1 for i in range(len(steps))], "n_good": int(pdf["n"].sum())})

    steps = written(both.unionByName(pool).groupBy("stratum", "pooled", "metric").applyInPandas(run, schema), "chains")
    chains = steps.select("stratum", "pooled", "metric").distinct().count()
    left, fallen = chains, -1
    while left:  # a chain that has fallen as a whole passes its share on; a round is one number
        share = math.log(level / left)
        now = steps.filter(F.col("last") & (F.col("needs") <= share)).count()
        if now == fallen or now >= chains:
            break
        fallen, left = now, chains - now
    share = math.log(level / left) if left else 0.0
    return steps.groupBy("stratum", "pooled", "metric").agg(F.min(F.when(F.col("needs") <= share, F.col("cutoff"))).alias("cutoff"), F.max("n_good").alias("n_good"))


def judged(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """stats with base_failed, failed (metrics above their stratum's cutoff) and kept."""
    cuts = written(cuts, "cutoffs")
    wide = lambda rows, mark: rows.groupBy("stratum").pivot("metric", list(METRICS)).agg(F.first("cutoff")).select(F.col("stratum").alias(f"{mark}s"), *[F.col(m).alias(f"{mark}{m}") for m in METRICS])
    own, pool = wide(cuts.filter("NOT pooled"), "_"), wide(cuts.filter("pooled"), "__").withColumn("__", F.lit(True))
    out = stats.join(own.withColumn("_", F.lit(True)), F.col("lang").eqNullSafe(F.col("_s")), "left")
    out = out.join(F.broadcast(pool), F.col("_").isNull() & F.col("__"), "left")  # one row at most
    cutoff = {m: F.when(F.col("_"), F.col(f"_{m}")).otherwise(F.col(f"__{m}")) for m in METRICS}
    failed = F.array_compact(F.array(*[F.when(metric(m) > cutoff[m] + 1e-9, F.lit(m)) for m in METRICS]))
    out = out.withColumn("base_failed", base_failed()).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.select(*stats.columns, "base_failed", "failed", "kept")


def op8_rules(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    stats = written(counts(table(spark, sf_dir, "documents")), "counts")
    cuts = cutoffs(stats, table(spark, sf_dir, "labels"))
    return judged(stats, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))
