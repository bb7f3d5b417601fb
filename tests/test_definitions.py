import pytest

from tsumugi.functions import chars
from tsumugi.sources import definitions as s


def test_char_definition():
    text = "# c\n\nALPHA 1 1 0 # x\nKANJI 0 0 2\n0x41..0x5A ALPHA # A-Z\n0x3005 KANJI NOOOVBOW\n"
    assert s.char_ranges(text) == [(0x41, 0x5A, chars.BIT["ALPHA"]), (0x3005, 0x3005, chars.BIT["KANJI"] | chars.BIT["NOOOVBOW"])]
    assert s.char_properties(text) == {"ALPHA": (1, 1, 0), "KANJI": (0, 0, 2)}
    for bad in ("0x5A..0x41 ALPHA", "0x41 WHAT"):
        with pytest.raises(ValueError):
            s.char_ranges(bad)


def test_unknown_words_and_matrix_and_rewrite():
    assert len(s.UNKNOWN) == 35 and len({u[4] for u in s.UNKNOWN}) == 9
    assert s.unknown_words("ALPHA,1,2,3,a,b,c,d,e,f", s.PROPERTIES) == [("ALPHA", 1, 2, 3, tuple("abcdef"))]
    with pytest.raises(ValueError):
        s.unknown_words("ALPHA,1,2,3,a,b,c,d,e,f", s.PROPERTIES, pos=set())
    assert s.matrix("2 3\n\n0 1 5\n1 2 -7\n0 0\n") == {(0, 1): 5, (1, 2): -7}
    with pytest.raises(ValueError):
        s.matrix("2 2\n5 0 1")
    assert s.rewrite_rules("# k\nⅠ\nか゛ が\n") == (frozenset("Ⅰ"), {"か゛": "が"})
    with pytest.raises(ValueError):
        s.rewrite_rules("a b\na c")


def test_settings():
    one = s.Settings.parse('{"Path": "/usr/share/d", "systemDict": "system.dic", "inputTextPlugin": [{"class": "x.y.DefaultInputTextPlugin"}, {"name": "ProlongedSoundMark", "class": "z"}], "userDict": ["a"], "other": 1}')
    assert one.system_dict == "/usr/share/d/system.dic" and [p["kind"] for p in one.text_plugins] == ["DefaultInputText", "ProlongedSoundMark"]
    both = one.then(s.Settings.parse('{"userDict": ["/b"], "systemDict": "/c"}'))
    assert both.user_dict == ["/usr/share/d/a", "/b"] and both.system_dict == "/c" and both.text_plugins == one.text_plugins
    assert s.Settings.parse('{"systemDict": "s"}', "/res").system_dict == "/res/s"
