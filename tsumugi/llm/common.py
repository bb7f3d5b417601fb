"""Shared pieces: reading tables, the shared folder, written tables, and files on any file system that pyarrow opens."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches by rows: a batch with several of the longest documents must still fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it in spark.checkpoint.dir; a temporary one only where
    that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tsumugi-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        base = "file://" + _OWN[app]
    return base.rstrip("/")


_MADE: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a folder not used before, inside the shared folder; what is left of it goes when the driver ends."""
    at = f"{shared_dir(spark)}/tsumugi-{what}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(lambda: [drop_folder(x) for x in _MADE])
    _MADE.append(at)
    return at


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, a lost executor costs nothing, and the
    planner knows the table's size, so that it broadcasts a small one by its own threshold and shuffles a large one."""
    spark = df.sparkSession
    at = new_folder(spark, what)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete `written` tables that no plan still to run reads."""
    for t in tables:
        drop_folder(t._written_at)


def drop_folder(uri: str) -> None:
    where, path = filesystem(uri)
    try:
        where.delete_dir(path)
    except (FileNotFoundError, OSError):  # gone already
        pass


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, made longer where a column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or of a plain local path."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a task that runs twice leaves one whole file."""
    where, path = filesystem(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with where.open_output_stream(part, compression=None) as out:
        out.write(data)
    where.move(part, path)


def get_file(uri: str, at: int | None = None, n: int = 0) -> bytes:
    """The file's bytes, or n of them from a place."""
    where, path = filesystem(uri)
    if at is not None:
        with where.open_input_file(path) as src:
            return src.read_at(n, at)
    with where.open_input_stream(path, compression=None) as src:
        return src.read()


def drop_file(uri: str) -> None:
    where, path = filesystem(uri)
    where.delete_file(path)


def prefix_sums(df: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Exclusive running sum of `value` in ascending `order` (a dense row number from 0), in two levels: within blocks
    of rows, and over the blocks' totals, so that the one task that sees all blocks gets rows / block rows."""
    from pyspark.sql import Window

    b = df.withColumn("_b", F.floor(F.col(order) / block))
    inner = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy("_b").agg(F.sum(value).alias("_t"))
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_above"))
    return (
        b.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(tops, "_b")
        .withColumn(out, (F.col("_in") + F.col("_above")).cast("long"))
        .drop("_b", "_in", "_above")
    )
