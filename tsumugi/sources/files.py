"""Text files as lines, files of any file system as bytes, lexicons and connection costs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(uri: str) -> bytes:
    from pyarrow import fs

    where, path = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, id (ascending within a file), text: a row per line of text files, ended by CR, LF or CRLF. Each text ends
    with a line's end, so that an empty line is a line for `morphemes` and `tsv` too."""
    rows = spark.read.text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.concat("value", F.lit("\n")).alias("text"))


LEXICON = ["headword", "left_id", "right_id", "cost", "surface", "p0", "p1", "p2", "p3", "p4", "p5", "reading", "normalized", "form_id", "unit_type", "a_split", "b_split", "word_structure"]


def _unescaped(col):
    """\\uXXXX and \\u{...} decoded, in the JVM: code points that hex digits name, in UTF-32."""
    parts = F.split(F.regexp_replace(col, r"\\u(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{4}))", "\u0001$1$2\u0002"), "\u0001")
    point = lambda p: F.decode(F.unhex(F.lpad(F.substring_index(p, "\u0002", 1), 8, "0")), "utf-32")
    return F.array_join(F.transform(parts, lambda p: F.when(p.contains("\u0002"), F.concat(point(p), F.substring_index(p, "\u0002", -1))).otherwise(p)), "")


def lexicon(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id (ascending within a file), the 18 columns of lexicon rows with escapes decoded (split columns as they stand),
    and error: what is wrong with a row, else null. Empty lines are left out."""
    rows = spark.read.text(paths).filter(F.length(F.trim("value")) > 0).select(F.monotonically_increasing_id().alias("id"), F.split("value", ",", -1).alias("c"))
    text = [F.get("c", F.lit(i)) if i >= 15 else _unescaped(F.get("c", F.lit(i))) for i in range(18)]
    out = rows.select("id", F.size("c").alias("n"), *[(c.try_cast("int") if n in ("left_id", "right_id", "cost") else c).alias(n) for n, c in zip(LEXICON, text)])
    in16 = lambda c: F.coalesce(F.col(c).between(-32768, 32767), F.lit(False))
    error = (
        F.when(F.col("n") != 18, F.concat(F.col("n").cast("string"), F.lit(" columns")))
        .when(F.col("headword") == "", "empty headword")
        .when(~(in16("left_id") & in16("right_id") & in16("cost")), "not 16 bits")
        .when(F.greatest(*[F.octet_length(c) for c in ("headword", "surface", "reading", "normalized")]) > 32767, "string too long")
        .when((F.col("unit_type") == "A") & ((F.col("a_split") != "*") | (F.col("b_split") != "*")), "a unit of type A has no splits")
    )
    return out.withColumn("error", error).drop("n")


def pos_ids(lex: DataFrame) -> DataFrame:
    """p0..p5 with pos_id, in the order in which a lexicon's rows name them first."""
    from pyspark.sql import Window

    p = [f"p{i}" for i in range(6)]
    first = lex.groupBy(*p).agg(F.min("id").alias("first"))  # a few hundred rows, whatever the lexicon's size
    return first.select(*p, (F.row_number().over(Window.orderBy("first")) - 1).alias("pos_id"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """left, right, cost from lines `left right cost` behind a first line of sizes; shorter lines are left out, a row
    beyond the sizes is an error."""
    head = spark.read.text(path).limit(1).first()
    left, right = (int(x) for x in (head[0].split() if head else [])[:2])
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).filter(F.size("c") >= 3).select(*[F.get("c", F.lit(i)).cast("int").alias(n) for i, n in enumerate(("left", "right", "cost"))])
    outside = F.raise_error(F.format_string("beyond the sizes: %d %d", "left", "right"))
    return cells.withColumn("cost", F.when((F.col("left") < left) & (F.col("right") < right) & (F.col("left") >= 0) & (F.col("right") >= 0), F.col("cost")).otherwise(outside.cast("int")))


_OWN: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """A folder that all executors see, below the one that the session names; a temporary one only where none is named,
    as in tests. It goes when the driver ends."""
    import atexit
    import shutil
    import tempfile
    import uuid

    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            _OWN[app] = f"{base.rstrip('/')}/tsumugi-files-{uuid.uuid4().hex[:12]}"
        else:
            at = tempfile.mkdtemp(prefix="tsumugi-files-")
            atexit.register(shutil.rmtree, at, True)
            _OWN[app] = "file://" + at
    return _OWN[app]


def put(uri: str, data: bytes) -> None:
    """Write under another name, then rename."""
    import os
    import uuid

    from pyarrow import fs

    where, path = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with where.open_output_stream(part, compression=None) as f:
        f.write(data)
    where.move(part, path)
