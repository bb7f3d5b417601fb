import random
import re
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import xxhash

from tsumugi.llm import graph, simhash


def test_family_covers():
    assert len(simhash.FAMILY) == 20
    assert all(any(set(t) <= set(s) for t in simhash.FAMILY) for s in combinations(range(8), 4))


def slow_fp(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for t in [None, "", " \n", "a", "A b\tC", "a b c d", "a b c d e", "ÀB É x", "w " * 300, *pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:25]]:
        assert simhash.fingerprint(t) == slow_fp(t)


def brute(fps, bits):
    n = len(fps)
    adj = [[j for j in range(n) if j != i and (fps[i] ^ fps[j]).bit_count() <= bits] for i in range(n)]
    comp = [-1] * n
    for i in range(n):
        if comp[i] < 0:
            todo = [i]
            comp[i] = i
            while todo:
                for j in adj[todo.pop()]:
                    if comp[j] < 0:
                        comp[j] = i
                        todo.append(j)
    return [len(a) for a in adj], comp


def test_links_equal_brute_force(spark):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(150)] + [0, 0, 2**64 - 1]
    for _ in range(700):  # chains and crowds of near ones
        x = rnd.choice(fps[:40] + fps[-60:])
        for b in rnd.sample(range(64), rnd.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    near, comp = brute(fps, 4)
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    keep, simhash.fingerprints = simhash.fingerprints, lambda d: d
    try:
        for hot in (4096, 7):
            got = {r.doc_id: (r.n_near, r.component_id) for r in simhash.near(df, hot=hot).collect()}
            assert got == {i: (near[i], comp[i]) for i in range(len(fps))}, hot
    finally:
        simhash.fingerprints = keep


def test_components_on_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 400), (400, 500)], "a long, b long")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {i: 0 for i in range(301)} | {400: 400, 500: 400}


def test_edges_and_dedup(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(4, None, 1), (2, "", 1), (7, t, 1), (5, t, 1), (5, t, 1), (9, "other words here", 1), (11, "z " * 60000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.n_near, r.component_id) for r in simhash.near(df).collect())
    assert got == [(2, 1, 2), (4, 1, 2), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 0, 9), (11, 0, 11)]
    kept = simhash.dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 9, 11]
    assert simhash.near(df.limit(0)).count() == 0


def test_dedup_keeps_null_ids_and_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (3, b), (5, c), (5, d), (5, d), (8, d), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.text) for r in simhash.dedup(df).collect())))
    assert got == sorted(map(str, [(None, a), (3, b), (5, c), (5, d), (None, None)]))
