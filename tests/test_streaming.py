from pyspark.sql import functions as F

from tsumugi.operators.morphemes import morphemes
from tsumugi.plans.registry import Latin
from tsumugi.streaming.tokens import stream


def test_one_large_file_is_dealt_to_all_cores(spark, tmp_path):
    texts = [None, "", "one two\nthree", *[f"text {i} of many" for i in range(400)]]
    d = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, other int")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    make, how = Latin(("one", "text")), {"columns": ["line_no", "i", "surface", "is_oov"], "keep": ["lang"]}
    rows = stream(spark, f"{tmp_path}/in", d.schema, make, "doc_id", **how)
    rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(rows.schema).parquet(f"{tmp_path}/out")
    want = morphemes(d, make, "doc_id", **how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select(F.input_file_name()).distinct().count() >= spark.sparkContext.defaultParallelism
