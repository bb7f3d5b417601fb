import hashlib
import random

import pyarrow.parquet as pq

from tsumugi.llm import suffix


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def compare(spark, texts, length):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(df, length).collect()}
    want = brute(texts, length)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    return df


def made(rnd, n, alphabet, length):
    text = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    shared = [text(rnd.randint(length // 2, 4 * length)) for _ in range(6)]
    out = [None, "", "a" * (7 * length), "ab" * (4 * length), "é" * length * 2]
    for _ in range(n):
        parts = [text(rnd.randint(0, 2 * length))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 3)
            parts += [s[a : len(s) - rnd.randint(0, len(s) // 3)], text(rnd.randint(0, length))]
        out.append("".join(parts))
    return out + out[-5:] + [out[-1][:-1] + "é", out[-2][3:]]


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    compare(spark, made(rnd, 60, "abcdefgh é\n", 40), 40)
    compare(spark, made(rnd, 60, "ab", 40), 40)


def test_block_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_STARTS", 50)
    df = compare(spark, made(random.Random(4), 40, "abcde", 40), 40)
    assert suffix.digests(df.limit(0), 40).count() == 0


def test_documents(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    compare(spark, texts, 400)


def test_two_lengths_at_once(spark):
    rnd = random.Random(8)
    texts = made(rnd, 60, "abcdefgh é", 40)
    texts += texts[7:12]
    df = spark.createDataFrame([(i % 70, t) for i, t in enumerate(texts)] + [(None, texts[9]), (-(2**63), texts[9])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.passage_removed, r.passage_spans) for r in suffix.digests(df, 90, 40).collect())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = [(str(d), *a, *b[1:3]) for (d, _), a, b in zip(rows, brute([t for _, t in rows], 90), brute([t for _, t in rows], 40))]
    assert got == sorted(want) and any(w[2] != w[5] for w in want)
    assert suffix.digests(df.limit(0), 90, 40).count() == 0


def test_passages_of_over_50_words_go(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(3, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in range(51, 61)]
    docs = [f"{words(40)} {p} {words(rnd.randint(5, 90))}" for p in passages * 3] + [words(120) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in enumerate(docs)], "doc_id long, text string, one int, two int, spans int, _d int, id int")
    got = {r.doc_id: r for r in suffix.dedup(df, suffix.PASSAGE).collect()}
    assert got[0].asDict().keys() == set(df.columns) and all(tuple(r)[2:] == (1, 2, 3, 4, 5) for r in got.values())
    for i, t in enumerate(docs):
        p = passages[i % 10] if i < 30 else ""
        assert (p not in got[i].text and len(got[i].text) >= len(t) - len(p) - 8) if p else got[i].text == t


def test_dedup_and_repeated_rows(spark):
    p = "".join(random.Random(1).choice("abcdefgh") for _ in range(100))
    df = spark.createDataFrame([(1, "x" + p + "y", 5), (1, "x" + p + "y", 5), (None, "q" + p, 6), (4, None, 7), (5, "left whole", 8)], "doc_id long, text string, th int")
    got = sorted((str(r.doc_id), r.text, r.th) for r in suffix.dedup(df, 40).collect())
    assert got == [("1", "", 5), ("1", "", 5), ("4", None, 7), ("5", "left whole", 8), ("None", "q", 6)]
    d = sorted((str(r.doc_id), r.n_removed) for r in suffix.digests(df, 40).collect())
    assert d == [("1", 102), ("1", 102), ("4", 0), ("5", 0), ("None", 100)]


def test_large_anchors_are_divided(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    texts = []
    for k in (20, 30, 39, 40, 41, 60, 90):  # lines in many texts, each time in other surroundings
        line = word(k)
        texts += [word(rnd.randint(0, 60)) + line + word(rnd.randint(0, 60)) for _ in range(60)]
        texts += [t[rnd.randint(0, 5) :] + "x" for t in texts[-8:]]
    texts += ["ab" * 90, "a" * 200, "xy" + "ab" * 50, *texts[:4], *made(rnd, 40, "ab", 40)]
    most = []
    keep = suffix.resolved

    def seen(rows, *how):
        most.append(rows.selectExpr("anchor", "length(snippet) AS k").groupBy("anchor").sum("k").agg({"sum(k)": "max"}).first()[0])
        return keep(rows, *how)

    monkeypatch.setattr(suffix, "resolved", seen)
    monkeypatch.setattr(suffix, "ANCHOR_BYTES", 1000, raising=False)
    compare(spark, texts, 40)
    assert most[0] <= 1000
