import random

import pyarrow.parquet as pq

from tsumugi.llm import spans


def brute(rows):
    """Plain version: every span of every text by its words, first occurrence by (doc_id, place)."""
    seen = {}
    for d, t in rows:
        parts = spans.sentences(t or "")
        real = [i for i, p in enumerate(parts) if p.split()]
        for k, i in enumerate(real):
            for e in range(k + 1, len(real) + 1):
                own = [parts[j].split() for j in real[k:e]]
                if len(own) >= spans.MIN_SENTENCES and sum(map(len, own)) >= spans.MIN_WORDS:
                    seen.setdefault(str(own), []).append((d, i, real[e - 1]))
                    break
    gone = {}
    for places in seen.values():
        for d, a, b in sorted(set(places))[1:]:
            gone.setdefault(d, set()).update(range(a, b + 1))
    return {d: "".join(p for i, p in enumerate(spans.sentences(t or "")) if i not in gone.get(d, ())) for d, t in rows}


def test_sentences_make_up_the_text():
    for t in ["", "a", "A b. C d! E?\nF", "x...  y\n\n z. ", "3.5 is. no", "\n\n", ". . ."]:
        assert "".join(spans.sentences(t)) == t
    assert spans.sentences("A b. C d!  E?\nF g") == ["A b. ", "C d!  ", "E?\n", "F g"]


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    sent = lambda: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 12))) + ". "
    shared = [[sent() for _ in range(rnd.randint(2, 7))] for _ in range(8)]
    rows = [(1000, None), (1001, ""), (1002, "En. En. " * 30), (1003, "no end " * 5000)]
    for d in range(60):
        parts = [sent() for _ in range(rnd.randint(0, 5))]
        for _ in range(rnd.randint(0, 3)):
            parts += rnd.choice(shared) + [rnd.choice(["\n", " ", ""]), sent()]
        rows.append((d, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos")
    out = spans.dedup(df)
    assert out.columns == df.columns
    want = brute(rows)
    for r in out.collect():
        assert (r.text or "") == want[r.doc_id], r.doc_id
    assert spans.dedup(df.limit(0)).count() == 0


def test_documents_and_odd_ids(spark):
    rows = list(enumerate(pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r.doc_id: r.text for r in spans.dedup(df).collect()} == want
    p = "One two three four five six. Seven eight nine ten eleven twelve."
    odd = spark.createDataFrame([(None, p), (5, p), (5, p), (6, p)], "doc_id int, text string")
    assert sorted((str(r.doc_id), r.text) for r in spans.dedup(odd).collect()) == [("5", p), ("5", p), ("6", ""), ("None", p)]


def test_shared_ids_and_clashing_columns(spark):
    p = "One two three four five six. Seven eight nine ten eleven twelve."
    z = "Another text that no other row has at all. It stays as it is, whatever its number."
    df = spark.createDataFrame([(1, p, 1, 2, 3, 4), (5, p, 1, 2, 3, 4), (5, z, 1, 2, 3, 4)], "doc_id long, text string, one int, two int, runs int, n_removed int").selectExpr("*", "7 as _n", "8 as _d", "9 as _gone")
    got = {(r.doc_id, r.text): tuple(r)[2:] for r in spans.dedup(df).collect()}
    assert got == {(1, p): (1, 2, 3, 4, 7, 8, 9), (5, ""): (1, 2, 3, 4, 7, 8, 9), (5, z): (1, 2, 3, 4, 7, 8, 9)}


def query(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: r.text for r in spans.op6_spans(spark, str(folder)).collect()}


def test_query_removes_all_later_copies(spark, tmp_path):
    word = iter(range(10**6))
    sent = lambda n: " ".join(f"w{next(word)}" for _ in range(n)) + ". "
    texts = [sent(60), sent(3), sent(20) + sent(3) + sent(3), "\n" + sent(5) + "\n\n" + sent(4), sent(2) * 9, "".join(sent(1 + i % 5) for i in range(40)), sent(30) + "\n\n"]
    got = query(spark, tmp_path, [(d, t) for d, t in enumerate(texts * 3)])
    assert [got[d] for d in range(7) if d != 4] == [t for d, t in enumerate(texts) if d != 4]
    assert [got[d] for d in range(7, 21)] == [""] * 14


def test_query_removes_passages_to_their_ends(spark, tmp_path):
    word = iter(range(10**6))
    sent = lambda n: " ".join(f"w{next(word)}" for _ in range(n)) + ". "
    rows, want = [], {}
    for k, sizes in enumerate([(20, 3, 3), (55,), (3, 60, 2), (12,), (1, 2, 3, 4, 5, 6, 7, 1, 1)]):
        passage = "".join(map(sent, sizes))
        for d in (2 * k, 2 * k + 1):
            before, after = sent(15) + sent(2), sent(4) + sent(15)
            rows.append((d, before + passage + after))
            want[d] = before + (passage if d % 2 == 0 else "") + after
    rows.append((100, sent(4) + rows[0][1].split(". ")[3] + ". " + sent(3)))  # three words of a passage alone
    want[100] = rows[-1][1]
    assert query(spark, tmp_path, rows) == want


def test_query_on_documents(spark, tmp_path):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:400]
    got = query(spark, tmp_path, [(d, t) for d, t in enumerate(texts)])
    first: dict = {}
    for d, t in enumerate(texts):
        assert not t or first.setdefault(t, d) == d or got[d] == ""
