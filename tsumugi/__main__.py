"""python -m tsumugi [-m A|B|C] [-a] [-f] [-s SETTINGS.json] [-p RESOURCES] -o FOLDER FILE...

Writes the morphemes of text files as TSV, each line's followed by EOS; -a adds forms, reading, dictionary and (OOV), -f
leaves out lines that can't be cut instead of failing. Without settings, the seed dictionary is used.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.factory import FromFiles
from .operators.morphemes import tsv
from .plans.registry import make_seed
from .sources import files


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("tsumugi", description=__doc__.split("\n\n")[1])
    p.add_argument("-m", dest="mode", choices=list("ABC"), default="C")
    p.add_argument("-a", dest="full", action="store_true")
    p.add_argument("-f", dest="lenient", action="store_true")
    p.add_argument("-s", dest="settings")
    p.add_argument("-p", dest="resources")
    p.add_argument("-o", dest="out", required=True)
    p.add_argument("files", nargs="+")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    make = FromFiles(files.read(o.settings).decode(), resource_dir=o.resources) if o.settings else make_seed
    rows = tsv(files.lines(spark, o.files), make, "id", mode=o.mode, full=o.full, strict=not o.lenient)
    rows.sort("id").select("text").write.text(o.out)


if __name__ == "__main__":
    main()
