import numpy as np

from tsumugi.llm import ordinal


def corpus(n, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rnd.integers(0, 300, rnd.integers(20, 120))]
        g = int(rnd.choice(3, p=[0.15, 0.2, 0.65]))
        if g == 0:
            for k in rnd.integers(0, len(words), 4):
                words[k] = rnd.choice(["scum", "Loser,", "idiot!"])
        if g == 1:
            words = [w + rnd.choice(["***", "!!", "%%%"]) for w in words]
        rows.append((i, " ".join(words), g))
    return rows


def test_held_out_accuracy_and_order():
    rows = corpus(1500, 1)
    w, t = ordinal.fit([(*ordinal.features(x), g) for _, x, g in rows])
    assert t[0] < t[1]
    cells = np.flatnonzero(w)
    s = ordinal.Scorer(cells, w[cells], t.tolist())
    test = corpus(600, 2)
    grade = np.array([g for *_, g in test])
    tails = np.array([s.tails(s.score(x)) for _, x, _ in test])
    assert (np.diff(tails, axis=1) <= 0).all()
    kept = tails[:, -1] >= 0.5
    assert kept[grade == 2].mean() > 0.98 and kept[grade < 2].mean() < 0.1
    expected = tails.sum(1)
    assert expected[grade == 2].mean() > expected[grade == 1].mean() > expected[grade == 0].mean() - 0.5
    for _, x, _ in test[:50]:  # the cached score is the plain sum
        i, v = ordinal.features(x)
        assert abs(s.score(x) - sum(w[a] * b for a, b in zip(i, v))) < 1e-6


def test_gradient_by_differences():
    rows = [(*ordinal.features(x), g) for _, x, g in corpus(60, 3)]
    a, ta = ordinal.fit(rows, rounds=150, min_docs=3)
    y = np.array([g for *_, g in rows])

    def loss(w, t):
        s = np.array([sum(w[c] * v for c, v in zip(i, vv)) for i, vv, _ in rows])
        p = np.column_stack([np.ones(len(s)), *[1 / (1 + np.exp(t_ - s)) for t_ in t], np.zeros(len(s))])
        k = np.arange(len(s))
        return -np.log(np.maximum(p[k, y] - p[k, y + 1], 1e-12)).mean()

    assert loss(a, ta) < 0.25 * loss(np.zeros_like(a), np.array([-1.0, 0.0]))


def test_operator(spark):
    rows = corpus(700, 4)
    docs = spark.createDataFrame([(i, x, "z") for i, x, _ in rows] + [(9000, None, "z"), (9001, "", "z"), (9002, " \n", None), (9003, "w1 scum " * 30000, "z"), (None, "w1 w2", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, None if i % 50 == 0 else int(g == 2 or g == 0), int(g == 0)) for i, _, g in rows] + [(777777, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.trained(docs, labels)
    a = {r.doc_id: (r.p_tail, r.kept) for r in ordinal.scored(docs, model).collect()}
    b = {r.doc_id: (r.p_tail, r.kept) for r in ordinal.scored(docs.repartition(5), ordinal.trained(docs.repartition(3), labels)).collect()}
    assert a == b and len(a) == len(rows) + 5
    assert not a[9000][1] and not a[9001][1] and not a[9002][1]
    good = [a[i][1] for i, _, g in rows if g == 2]
    assert np.mean(good) > 0.97
    assert len(ordinal.sample(docs, labels, most=50)) <= 50
    none = ordinal.scored(docs, ordinal.trained(docs, labels.limit(0)))
    assert {r.doc_id: r.kept for r in none.collect()}[9002] is False
    assert ordinal.scored(docs.limit(0), model).count() == 0
