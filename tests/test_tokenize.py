import itertools
import random

import pyarrow as pa
import pytest

from tsumugi.operators import dictionary as d
from tsumugi.operators.morphemes import _BUILT, BYTES, MAKERS, TEXTS, Runs, _built, parts
from tsumugi.operators.tokenize import NoMorpheme, Tokenizer, auto_cost
from tsumugi.plans.registry import Latin


@pytest.fixture(scope="module")
def dic():
    x = d.Dictionary(d.SYSTEM, d.MATRIX)
    x.add(d.USER, auto_cost)
    return x


def surfaces(t, s, mode="C"):
    return [r[2] for r in t.tokenize(s, mode)]


def test_sample_sessions(dic):
    t = Tokenizer(dic)
    assert surfaces(t, "東京都へ行く") == ["東京都", "へ", "行く"]
    assert surfaces(t, "東京都へ行く", "A") == ["東京", "都", "へ", "行く"]
    assert [r[6] for r in t.tokenize("東京都へ行く")] == ["トウキョウト", "エ", "イク"]
    assert surfaces(t, "電気通信大学", "B") == ["電気通信", "大学"] and surfaces(t, "電気通信大学", "A") == ["電気", "通信", "大学"]
    assert t.tokenize("行った")[0][5] == "行く"
    assert surfaces(t, "") == []
    with pytest.raises(ValueError):
        t.tokenize("x", "D")


def test_prefixes_in_order(dic):
    assert [e for _, e in dic.prefixes("電気通信大学大学院", 0)] == [2, 4, 6]
    assert [w[0] for w, _ in dic.prefixes("東京タワー", 0)] == [1, 0]


def test_user_dictionary_and_auto_cost(dic):
    t = Tokenizer(dic)
    assert dic.layers[1][0].cost != -32768
    got = t.tokenize("東京タワーへ")
    assert got[0][2] == "東京タワー" and got[0][8] == 1
    assert surfaces(t, "東京タワーへ", "A") == ["東京", "タワー", "へ"]


def test_numbers_and_katakana(dic):
    ref, intent = Tokenizer(dic), Tokenizer(dic, compat="intent")
    norm = lambda t, s: [r[4] for r in t.tokenize(s)]
    assert norm(ref, "12万3456") == ["123456"] and norm(ref, "1,000の") == ["1000", "の"]
    assert norm(ref, "二千三百") == ["230000"] and norm(intent, "二千三百") == ["2300"]
    assert norm(ref, "1.5") == ["1", ".", "5"] and norm(intent, "1.5") == ["1.5"]
    assert norm(ref, "1,00") == ["1", ",", "00"] or norm(ref, "1,00")[0] == "1"
    assert surfaces(ref, "アイスクリーム") == ["アイスクリーム"]
    off = Tokenizer(dic, rewrite=())
    assert len(off.tokenize("12万")) == 3


def test_offsets_tile_the_original(dic):
    t = Tokenizer(dic)
    rnd = random.Random(1)
    abc = "東京都へ行くアイス1２,.ab ｶﾞ㍿ー々〇"
    for _ in range(300):
        s = "".join(rnd.choice(abc) for _ in range(rnd.randint(1, 14)))
        try:
            got = t.tokenize(s)
        except NoMorpheme:
            continue
        assert got[0][0] == 0 and got[-1][1] == len(s)
        assert all(a[1] == b[0] for a, b in itertools.pairwise(got))


def test_least_cost_equals_brute_force(dic):
    t = Tokenizer(dic, rewrite=())
    rnd = random.Random(2)
    for _ in range(60):
        s = "".join(rnd.choice("東京都大学院電気a1の") for _ in range(rnd.randint(1, 7)))
        _, _, edges = t.lattice(s)

        def every(at):
            if at == len(s):
                yield []
            for e in edges:
                if e.begin == at:
                    for rest in every(e.end):
                        yield [e, *rest]

        def cost(p):
            ids = [0, *[e.right for e in p]]
            return sum(e.cost for e in p) + sum(dic.matrix.get((a, b), 0) for a, b in zip(ids, [*[e.left for e in p], 0]))

        assert cost(t.best(len(s), edges)) == min(cost(p) for p in every(0))


def test_inhibited_connection():
    x = d.Dictionary(d.SYSTEM, d.MATRIX)
    before = surfaces(Tokenizer(x), "東京都へ")
    x.inhibit(4791, 100)
    after = surfaces(Tokenizer(x), "東京都へ")
    assert before == ["東京都", "へ"] and after != before


def test_rows_are_checked():
    ok = d.SYSTEM[0]
    for bad in ("a,b", ok.replace("5000", "50000"), ok + ",x", ok[: ok.index(",")] and ok.replace("A,*,*", "A,1/2,*")):
        with pytest.raises(ValueError):
            d.parse_row(bad)
    assert d.parse_row(ok.replace("東京,", "\\u6771\\u{4eac},", 1)).headword == "東京"
    assert d.Dictionary(d.SYSTEM).printed()[2].split(",")[14] == "B" or d.Dictionary(d.SYSTEM).printed()[2]


def test_run_cache_changes_nothing():
    rows = [d._row(w, 5139, 3000 + 100 * len(w), d.NOUN, w) for w in ("foo", "bar", "fo")]
    fast = Tokenizer(d.Dictionary(rows), marks=(), rewrite=())
    slow = Tokenizer(d.Dictionary(rows), marks=(), rewrite=())
    slow.by_run = False
    assert fast.by_run
    for s in ["foo bar  baz-1,000!", "Fo o", "é\tfoo", "日本 foo", "a1b2--c"]:
        assert fast.tokenize(s) == slow.tokenize(s), s


def test_unknown_letters_need_no_lattice():
    rows = [d._row(w, 5139, 3000 + 100 * len(w), d.NOUN, w) for w in ("foo", "foobar", "f", "e" * 90)]
    for how in ({}, {"oov": ("simple",)}, {"oov": ("simple", "mecab")}, {"properties": {"ALPHA": (0, 1, 0)}}, {"properties": {"ALPHA": (1, 0, 3)}}):
        t = Tokenizer(d.Dictionary(rows), marks=(), rewrite=(), **how)
        runs, made = Runs(t), []

        def lattice(text, own=Tokenizer.lattice.__get__(t)):
            made.append(text)
            return own(text)

        t.lattice = lattice
        for s in ["foo", "FOO", "foob", "Foobar", "foobarx", "x", "xy", "xyz", "wxyz", "Éß", "e" * 90, "e" * 91]:
            made.clear()
            try:
                got = runs.analysed(s)
            except NoMorpheme:
                got = None
            if not how:
                assert bool(made) == (s.lower() in ("foo", "foobar", "e" * 90))
            try:
                want = [(b, e, x, ",".join(p), *rest) for b, e, x, p, *rest in t.tokenize(s)]
            except NoMorpheme:
                want = None
            assert got == want, (s, how)


def test_a_worker_holds_texts_by_bytes():
    texts = ["x" * 10, None, "é" * BYTES, "", *["y" * (BYTES // 3)] * 4, *["z"] * 1000]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(parts(b, 1))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts
    sizes = [[len((x or "").encode()) for x in p.column(1).to_pylist()] for p in got]
    assert all(len(x) <= TEXTS and (sum(x) <= BYTES or len(x) == 1) for x in sizes) and max(map(sum, sizes)) == 2 * BYTES
    assert list(parts(b.slice(0, 0), 1)) == []
    cut = b.slice(3, 8)
    assert [x for p in parts(cut, 1) for x in p.column(1).to_pylist()] == texts[3:11]


def test_a_worker_keeps_wanted_columns_and_few_tokenizers():
    made = [Latin((w,)) for w in ("a", "b", "c", "d", "e", "f")]
    for m in made:
        t, runs = _built(m, ["pos"])
        assert _built(m, ["pos"]) == (t, runs)
        runs.gather([runs.numbers("abc a 12")], ["pos"], {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()})
        assert list(runs.columns) == ["pos"] and _built(m, ["is_oov"])[1].number.keys() == {"\n", "\r", "\r\n"}
    assert len(_BUILT) <= MAKERS and made[-1] in _BUILT
