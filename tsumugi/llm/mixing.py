"""Mixing sources to target weights.

The words of each source are summed; weights share out a total; a source whose share is above a multiple of its size
stops there and the excess is shared again by weight until none is above. A source's repetition rate is its target over
its size; each document is emitted floor(rate) times, plus one more time with probability equal to the fraction, drawn
from a hash of seed and doc_id, so that reruns agree.

All of it is DataFrame work. The rounds of sharing need two numbers each (what stopped sources take, and the weight of
the rest), so a round is one aggregate over a row per source and sends one row to the driver. Sources are numbered with
a range-parted sort, not by one task. Null text has size 0; null is a source of its own, the last; an empty table gives
no rows. Rows with the same doc_id draw alike, and so do all rows without one. `mix` keeps all columns as they are;
`drawn` replaces those named as its outputs. Draws are independent: what a source takes scatters around its target, by
0.878 to 1.216 of it at 1,000 documents, by 0.908 to 1.038 at 10,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, prefix_sums, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
SEED = 42


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Dense row numbers from 0 in the given order: sorted by ranges, numbered within each, offsets from the ranges'
    counts (a row per range)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    base = prefix_sums(counts, "_part", "_n", "_base").select("_part", "_base")
    return rows.join(base, "_part").withColumn(out, (F.col("_id") - F.shiftleft("_part", 33) + F.col("_base")).cast("long")).drop("_id", "_part", "_base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """From (source, source_size), one row per source: adds weight and target. Weights repeat over the sources in the
    order of their code points, null last; `total` is a multiple of all sizes, `most` of a source's own."""
    n = len(weights)
    order = [F.col("source").isNull().cast("int"), F.col("source").asc()]
    rows = numbered(sizes, order, "_rank")
    rows = written(rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % n + 1).cast("int")).cast("long")).drop("_rank"), "sources")
    cap = F.lit(most) * F.col("source_size")
    words, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    stopped, rest = 0.0, weight
    while True:
        share = (total * words - stopped) / rest if rest else 0.0
        over = F.lit(share) * F.col("weight") > cap
        took, left = rows.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if left == rest or not left:
            break
        stopped, rest = took, left
    return rows.withColumn("target", F.least(cap, F.lit(share) * F.col("weight")) if rest else cap)


def drawn(docs: DataFrame, text: str = "text", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """The documents with size, source_size, target (of the source) and copies."""
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", size(text))
    (key,) = free(docs, "key", "source_size", "target")[:1]
    # read twice: sums first, with partial sums before the shuffle, then each document against its source's row
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum("size").cast("long").alias("source_size"))
    per = targets(sizes, weights, total, most).select(F.col("source").alias(key), "source_size", "target")
    both = docs.join(per, F.col("source").cast("string").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return both.withColumn("copies", (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows: each document as often as drawn, in the columns it came with."""
    some = docs.select("doc_id", how.get("text", "text"), "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return drawn(some, **how).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = drawn(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, 2.0 * source_size AS cap FROM w),
o AS (SELECT *, row_number() OVER win AS k, coalesce(sum(cap) OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
             sum(weight) OVER (win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c WINDOW win AS (ORDER BY cap / weight, weight, source)),
q AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM s) - stopped) / rest AS share FROM o),
l AS (SELECT arg_min(share, k) FILTER (share * weight <= cap) AS share FROM q),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT share FROM l) * weight) AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             ('0x' || md5('42:' || coalesce(d.doc_id::VARCHAR, ''))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + (CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)))::BIGINT AS taken FROM r
"""
