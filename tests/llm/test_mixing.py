import re

import duckdb
import pytest

from tsumugi.llm import mixing


def water(sizes, weights, total, most):
    """Plain sharing: stop what is above, share the excess by weight, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    todo, left, out = set(names), total * sum(sizes.values()), {}
    while todo:
        share = left / sum(w[s] for s in todo)
        over = {s for s in todo if share * w[s] > most * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in todo}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        todo -= over
    return out


ROWS = [(i, ("w " * (i * 37 % 50)).strip() if i % 13 else None, f"s{i % 7}" if i % 5 else None, "x") for i in range(900)] + [(3, "a b", "s3", "x")] * 2 + [(5000, "Z", "Ä", "x"), (5001, "", "empty", "x"), (5002, "w " * 4000, "S0", "x")]


def test_targets_and_draws(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, target string")
    got = mixing.drawn(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = water(sizes, (3, 1, 2), 1.5, 2.0)
    assert len(got) == len(ROWS)
    took = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == words(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        took[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(took[s] - want[s]) < 0.25 * want[s] + 60
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.drawn(df.repartition(3)).collect()))
    m = mixing.mix(df)
    assert m.columns == df.columns and m.count() == sum(r.copies for r in got)
    assert mixing.drawn(df.limit(0)).count() == 0


def test_any_other_columns_stay(spark):
    names = ["_key", "_copy", "copies", "size", "source_size", "target", "key", "row", "col"]
    df = spark.createDataFrame([r[:3] for r in ROWS], "doc_id long, text string, source string").selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    got = mixing.mix(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(names)))}
    assert {"_key", "_copy", "row"} <= set(mixing.drawn(df).columns)


def test_sql_gives_the_same(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, target string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {(a, b, c, round(d, 6), e) for a, b, c, d, e in con.sql(mixing.OP5_SQL).fetchall()}
    got = {(r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in mixing.drawn(df).collect()}
    assert got == want
