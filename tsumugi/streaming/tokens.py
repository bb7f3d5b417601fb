"""Morphemes of a stream: the map keeps no state, so a streaming DataFrame goes through unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.morphemes import morphemes


def stream(spark: SparkSession, path: str, schema, make, key: str, **how) -> DataFrame:
    """A batch's rows are dealt to four tasks a core: its files are few and of any size, and no core is to wait for the
    last one. Texts are shuffled, which costs little beside the morphemes that come of them."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    few = files.select(*dict.fromkeys([key, *how.get("keep", ()), how.get("text", "text")]))
    return morphemes(few.repartition(4 * spark.sparkContext.defaultParallelism), make, key, **how)


def register_udtf(spark: SparkSession, name: str, make) -> None:
    """SQL table function name(text, mode): begin, end, surface, pos, normalized_form."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="begin int, end int, surface string, pos string, normalized_form string")
    class Tokens:
        def __init__(self):
            self.t = make()

        def eval(self, text: str, mode: str):
            for b, e, s, p, n, *_ in self.t.tokenize(text or "", mode):
                yield b, e, s, ",".join(p), n

    spark.udtf.register(name, Tokens)
