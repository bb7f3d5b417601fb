import math
import re

import pytest
import pyarrow.parquet as pq

from tsumugi.llm import rules


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = set()
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts():
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if len(t) < 6000][:150]
    texts += [None, "", " \n\x0b\n", "a b c d e a b c d e", "a a a a a a a", "x\n\nx\n x\nx", " \x85 \x1c", "a b c d e f a b c d", "# | <>\r\n# | <>\r\n", "日本 語" * 9]
    for t in texts:
        assert rules.count(t)[:5] == brute(t), t


def test_binomial_and_selection():
    n, k, p = 40, 3, 0.1
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert abs(math.exp(rules.log_tail(n, k, p)) - want) < 1e-12
    assert rules.lowest_safe({0: 50}, 0.004, 0.01) is None and rules.lowest_safe({}, 0.1, 0.05) is None
    got = rules.lowest_safe({0: 5000, 1: 200, 7: 6, 9: 3}, 0.004, 0.01)
    assert got == 1  # above cell 1 lie 9 of 5209, cutting at 0 would reject 209
    assert rules.log_tail(5209, 9, 0.004) <= math.log(0.01) < rules.log_tail(5209, 209, 0.004)


def test_verdicts(spark):
    good = [(i, " ".join(f"w{i * j % 997}x{j}" for j in range(30)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}{j}***" for j in range(30)), "en") for i in range(50)]
    odd = [(20_000, None, "en"), (20_001, "", None), (20_002, "too few", "xx"), (20_003, "*** " * 30, "xx"), (20_003, "*** " * 30, "xx")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as n_words")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(1, None, None), (99_999, 1, 0), (10_001, 0, 0)], "doc_id long, quality int, toxic int")
    stats = rules.counts(docs)
    got = rules.judged(stats, rules.cutoffs(stats, labels)).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(good) + len(bad) + len(odd)
    assert all(kept[i] for i in range(3000)) and not any(kept[10_000 + i] for i in range(50))
    assert not kept[20_000] and not kept[20_001] and not kept[20_002] and not kept[20_003]
    empty = rules.judged(rules.counts(docs.limit(0)), rules.cutoffs(stats, labels.limit(0)))
    assert empty.count() == 0


def plain(docs, labels, risk, level):
    """Cutoffs and verdicts without Spark: doc_id -> kept."""
    stats = {d: (lang, dict(zip(rules.COUNTS, rules.count(t)))) for d, t, lang in docs}
    failed = lambda c: c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
    value = lambda c, m: c[rules.METRICS[m][0]] / c[rules.METRICS[m][1]] if c[rules.METRICS[m][1]] else 0.0
    good = [d for d, q, t in labels if q == 1 and not t and d in stats and not failed(stats[d][1])]
    langs = {stats[d][0] for d in good}
    least = rules.least_labels(max(1, (len(langs) + 1) * len(rules.METRICS)), risk, level)
    own = {x for x in langs if sum(stats[d][0] == x for d in good) >= least}
    chains = {}
    rest = sum(stats[d][0] not in own for d in good)
    for d in good:
        small = stats[d][0] not in own
        for name in [rules.POOLED] * (small or 0 < rest < least) + [stats[d][0]] * (not small):
            for m in rules.METRICS:
                cell = math.ceil(value(stats[d][1], m) / rules.METRICS[m][2])
                cells = chains.setdefault((name, m), {})
                cells[cell] = cells.get(cell, 0) + 1
    left = len(chains)
    while chains:
        cut = {k: rules.lowest_safe(c, risk, level / left) for k, c in chains.items()}
        now = len(chains) - sum(cut[k] == min(c) for k, c in chains.items())
        if now in (0, left):
            break
        left = now
    kept = {}
    for d, (lang, c) in stats.items():
        cuts = {m: cut.get((lang if lang in own else rules.POOLED, m)) for m in rules.METRICS} if chains else {}
        kept[d] = not failed(c) and all(x is None or value(c, m) <= x * rules.METRICS[m][2] + 1e-9 for m, x in cuts.items())
    return kept


@pytest.mark.parametrize("n", [3400, 2300])
def test_verdicts_equal_plain_version(spark, n):
    import random

    rnd = random.Random(4)
    word = lambda bad: rnd.choice(["word", "Some", "other", "LOUD", "x!", "a|b", "**"] if bad else ["word", "some", "other", "text", "Fine.", "x!"]) + str(rnd.randint(0, 999))
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i < 1500 else "de" if i < 2200 else rnd.choice(["fr", "es", None])
        bad = rnd.random() < 0.25
        docs.append((i, " ".join(word(bad) for _ in range(rnd.randint(8, 40))), lang))
        if lang != "es" and i % 7:
            labels.append((i, 0 if bad else 1, 0 if rnd.random() < 0.97 else None))
    df, lb = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = rules.counts(df)
    cuts = rules.cutoffs(stats, lb)
    got = {r.doc_id: r.kept for r in rules.judged(stats, cuts).collect()}
    assert got == plain(docs, labels, rules.RISK, rules.LEVEL)
    said = {(r.stratum, r.pooled) for r in cuts.collect() if r.cutoff is not None}
    assert said == {("en", False), ("de", False), (None, True)}
    gone = {docs[i][2] for i, k in got.items() if not k and rules.count(docs[i][1])[0] >= 10}
    assert gone == {"en", "de", "fr", "es", None}


def test_error_rate_by_simulation():
    """Over many holdouts the chosen cutoff rejects more than `risk` of good documents in at most `level` of them."""
    import numpy as np

    rnd, risk, level, wrong, runs = np.random.default_rng(5), 0.05, 0.1, 0, 1500
    p = np.array([0.5, 0.2, 0.15, 0.06, 0.04, 0.03, 0.02])  # of cells 0, 1, ...: cutting at 3 rejects 0.09, at 4 0.05
    for _ in range(runs):
        n = np.bincount(rnd.choice(len(p), 400, p=p), minlength=len(p))
        best = rules.lowest_safe({i: int(k) for i, k in enumerate(n) if k}, risk, level)
        wrong += best is not None and p[best + 1 :].sum() > risk + 1e-12
    assert wrong <= level * runs
