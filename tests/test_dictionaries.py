"""Compiled dictionaries, tries, tables of source files, settings and plugins of one's own."""

import json
import random

import numpy as np
import pytest

from tsumugi.functions import chars
from tsumugi.operators import dictionary as dic
from tsumugi.operators import factory
from tsumugi.operators.morphemes import morphemes, tsv
from tsumugi.operators.tokenize import Node, Tokenizer, auto_cost
from tsumugi.plans import dictionaries as q
from tsumugi.sources import binary, definitions, files


def test_trie_finds_what_a_table_finds():
    rnd = random.Random(1)
    keys = sorted({bytes(rnd.choice(b"abcd\xe3\x81\xff") for _ in range(rnd.randint(1, 9))) for _ in range(3000)} | {k.encode() for k in q.KEYS})
    units = binary.build_trie(keys, list(range(len(keys))))
    assert binary.trie_keys(units) == [(k, i) for i, k in enumerate(keys)]
    of = {k: i for i, k in enumerate(keys)}
    for _ in range(500):
        text = bytes(rnd.choice(b"abcd\xe3\x81\xff") for _ in range(14))
        assert binary.prefixes(units, text, 2) == [(of[text[2:e]], e) for e in range(3, 15) if text[2:e] in of]
        assert binary.exact(units, text[:4]) == of.get(text[:4])
    assert binary.prefixes(binary.build_trie([], []), b"a") == []
    for bad in ([b""], [b"b", b"a"], [b"a\0"]):
        with pytest.raises(ValueError):
            binary.build_trie(bad, [0] * len(bad))


def test_longest_key_and_its_prefixes():
    units = binary.build_trie([k.encode() for k in q.KEYS], [0, 1, 2, 3, 4])
    assert binary.prefixes(units, q.KEYS[-1].encode()) == [(i, len(k.encode())) for i, k in enumerate(q.KEYS)]
    assert binary.prefixes(units, ("あ" + q.KEYS[-1]).encode(), 3) == [(i, 3 + len(k.encode())) for i, k in enumerate(q.KEYS)]


@pytest.mark.parametrize("utf16", [False, True])
def test_compile_load_and_convert(utf16, tmp_path):
    made = q._raw()
    system, user = (binary.dump(binary.compiled(made, k, 1_700_000_000, "words", q.SIZES), utf16) for k in (0, 1))
    assert binary.convert(binary.convert(system, utf16, not utf16), not utf16, utf16) == system
    back = binary.load(system, [user], utf16)
    for k in (0, 1):
        assert back.printed(k) == made.printed(k)
    assert back.matrix == made.matrix and back.pos_list == made.pos_list and {h: i for h, i in back.lookup.items()} == made.lookup
    t, u = Tokenizer(back), Tokenizer(made)
    assert [t.tokenize(s, m) for s in q.base.SENTENCES for m in "ABC"] == [u.tokenize(s, m) for s in q.base.SENTENCES for m in "ABC"]
    costs = binary.load(system, [user], utf16, auto_cost)
    assert [w.cost for w in costs.layers[1]] == [w.cost for w in q.base.seed().layers[1]]
    for wrong in (lambda: binary.load(user), lambda: binary.load(system, [system], utf16), lambda: binary.parse(b"x" * 300)):
        with pytest.raises(ValueError):
            wrong()
    lines = binary.header_lines("a.dic", user)
    assert lines[:2] == ["filename: a.dic", "type: user dictionary"] and lines[3] == "description: words" and "2023-11-1" in lines[2]
    with pytest.raises(ValueError):
        binary.dump(binary.parse(system, utf16)._replace(header=binary.Header(binary.SYSTEM, 0, "x" * 257)))


def test_ids_of_parts_of_speech():
    row = lambda w, p: dic._row(w, 1, 1, p, w)
    d = dic.Dictionary([row("a", "p,*,*,*,*,*"), row("b", "q,*,*,*,*,*"), row("c", "p,*,*,*,*,*")])
    d.add([row("d", "r,*,*,*,*,*"), row("e", "q,*,*,*,*,*")])
    d.add([row("f", "s,*,*,*,*,*"), row("g", "r,*,*,*,*,*")])
    pos = lambda x: (x, *"*****")
    assert [p[0] for p in d.pos_list] == ["p", "q", "r", "s", "r"]
    assert (d.pos_id(pos("q"), 2), d.pos_id(pos("r"), 1), d.pos_id(pos("s"), 2), d.pos_id(pos("r"), 2), d.pos_id(pos("x"))) == (1, 2, 3, 4, -1)
    # in its own file a user's parts of speech follow the system's, whatever came between
    assert binary.compiled(d, 2).pos_ids == [2, 3] and binary.compiled(d, 2).pos == [pos("s"), pos("r")]


def test_category_table_against_written_ranges():
    # blocks of symbols, copied as ranges from the definition's comments: from, to, category
    want = {**{c: "SYMBOL" for a, b in ((0x2501, 0x26FE), (0x2700, 0x27BF), (0x27C0, 0x27FF), (0x2800, 0x28FF), (0x2900, 0x297F), (0x2A00, 0x2AFF), (0x2B00, 0x2BFF)) for c in range(a, b + 1)}, 0x26FF: "DEFAULT", **dict.fromkeys(range(0x2980, 0x2A00), "DEFAULT")}
    c = chars.Categories()
    assert {k for k, v in want.items() if c.mask(chr(k)) != chars.BIT[v]} == set()


def test_settings_build_a_tokenizer(tmp_path):
    s = definitions.Settings.parse(q.SETTINGS)
    t = factory.tokenizer(s, q.base.seed())
    assert [x[2] for x in t.tokenize("東京都へ行く")] == ["東京都", "へ", "行く"] and t.tokenize("12万3456")[0][4] == "123456"
    plain = factory.tokenizer(definitions.Settings.parse('{"oovProviderPlugin": [{"class": "MeCabOovProviderPlugin"}]}'), q.base.seed())
    assert plain.tokenize("Ａ")[0][4] == "Ａ" and not plain.rewrite
    for key in ("inputTextPlugin", "oovProviderPlugin", "pathRewritePlugin", "editConnectionCostPlugin"):
        with pytest.raises(ValueError, match="Nope is unknown"):
            factory.tokenizer(definitions.Settings.parse(json.dumps(json.loads(q.SETTINGS) | {key: [{"class": "x.Nope"}]})), q.base.seed())
    d = dic.Dictionary(dic.SYSTEM, dic.MATRIX)
    factory.tokenizer(definitions.Settings.parse(json.dumps(json.loads(q.SETTINGS) | {"editConnectionCostPlugin": [{"class": "InhibitConnectionPlugin", "inhibitedPair": [[4791, 100]]}]})), d)
    assert d.matrix[4791, 100] == 32767
    (tmp_path / "c.def").write_text("0x0041..0x005A ALPHA\n")
    (tmp_path / "r.def").write_text("ab xy\n")
    other = json.loads(q.SETTINGS) | {"path": str(tmp_path), "characterDefinitionFile": "c.def", "inputTextPlugin": [{"class": "DefaultInputTextPlugin", "rewriteDef": str(tmp_path / "r.def")}]}
    t = factory.tokenizer(definitions.Settings.parse(json.dumps(other)), q.base.seed())
    assert t.text("abc")[0] == "xyc" and t.cats.mask("A") == chars.BIT["ALPHA"] and t.cats.mask("b") == chars.BIT["DEFAULT"]


def test_plugins_of_ones_own():
    d = q.base.seed()
    digits = lambda text, at, mask, end, has: [] if has else [Node(at, end, 0, 0, 1, None, ("own", *"*****"), text[at:end], text[at:end], text[at:end], "", True)]
    shout = lambda chars_, places: ([c.upper() for c in chars_], places)
    last = lambda path, masks, ends, edges: path[-1:]
    factory.register("unknown words", "Own", lambda o, d: {"oov": (digits,)})
    factory.register("input text", "Shout", lambda o, d: {"texts": (shout,)})
    factory.register("path rewriting", "Last", lambda o, d: {"rewrite": (last,)})
    t = factory.tokenizer(definitions.Settings.parse('{"inputTextPlugin": [{"name": "Shout"}], "oovProviderPlugin": [{"name": "Own"}], "pathRewritePlugin": [{"name": "Last"}]}'), d)
    assert [(x[2], x[3][0], x[4]) for x in t.tokenize("東京abc")] == [("abc", "own", "ABC")]
    for bad in ({"oov": ("mecab", "other")}, {"rewrite": ("kana",)}, {"oov": ()}):
        with pytest.raises(ValueError):
            Tokenizer(d, **bad)


def test_stages_of_analysis():
    got = Tokenizer(q.base.seed()).dump("12万")
    assert got[0] == ("text", 0, 3, "12万", 0)
    assert [x[3] for x in got if x[0] == "before rewriting"] == ["1", "2", "万"] and [x[3] for x in got if x[0] == "after rewriting"] == ["12万"]
    assert {x[3] for x in got if x[0] == "lattice"} >= {"1", "2", "12", "万"}


def test_plain_runs_equal_the_lattice(spark):
    """Texts cut by runs give what the lattice gives, line by line."""
    make = q.base.Latin(("word", "été", "a"))
    t = make()
    texts = ["Word a,  b\r\nété\tx1\n\nÉTÉ!?\rend ", "\n", "", None, "½ word", "東京 word", "a" * 50 + "\n" + "a b " * 30, "\r\n\r\n", "ª²", "x\x85y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "id * 2 AS twice")
    got = sorted(map(tuple, morphemes(df, make, "id", keep=["twice"]).drop("error").collect()))
    want, lines = [], []
    from tsumugi.operators.morphemes import lines_of

    for k, x in enumerate(texts):
        for no, line in enumerate(lines_of(x or "")):
            rows = [(k, 2 * k, no, i, b, e, s, ",".join(p), n, f, r, o, d, w) for i, (b, e, s, p, n, f, r, o, d, w) in enumerate(t.tokenize(line))]
            want += rows
            lines.append((k, no, "\n".join([*("\t".join([r[6], r[7], r[8], r[9], r[10], str(r[12]), *["(OOV)"] * r[11]]) for r in rows), "EOS"])))
    assert got == sorted(want)
    assert sorted(map(tuple, tsv(df, make, "id", full=True).collect())) == sorted(lines)


def test_source_tables(spark, tmp_path):
    (tmp_path / "m.def").write_text("2 3\n0 1 5\n\n1 2 -7\n0 0\n")
    assert sorted(map(tuple, files.matrix(spark, str(tmp_path / "m.def")).collect())) == [(0, 1, 5), (1, 2, -7)]
    (tmp_path / "bad.def").write_text("2 2\n5 0 1\n")
    with pytest.raises(Exception, match="beyond the sizes"):
        files.matrix(spark, str(tmp_path / "bad.def")).collect()
    (tmp_path / "t.txt").write_bytes("a\r\n\rb\nc".encode())
    assert [r.text for r in files.lines(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == ["a\n", "\n", "b\n", "c\n"]


def test_command_writes_lines_in_order(spark, tmp_path):
    from tsumugi.__main__ import main

    (tmp_path / "in.txt").write_text(q.TEXT, newline="")
    main(["-m", "A", "-a", "-o", str(tmp_path / "out"), str(tmp_path / "in.txt")])
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert got.count("EOS") == 5 and got[0].split("\t")[:5] == ["東京", "名詞,固有名詞,地名,一般,*,*", "東京", "東京", "トウキョウ"] and got[4:6] == ["EOS", "EOS"]
