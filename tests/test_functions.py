import pytest

from tsumugi.functions import chars, normalize, numeric

BOTH = {"1,000": "1000", "007": "007", "二十三": "23", "10万": "100000", "2千30": "2030", "12万3456": "123456", "二〇一九": "2019"}
TWO = {"1.5": (None, "1.5"), "二千三百": ("230000", "2300"), "三百二十": ("3200", "320"), "百二十三": ("1203", "123"), "千五百万": ("1500000000", "15000000")}


def test_numerals():
    for t, v in BOTH.items():
        assert numeric.parse(t)[2] == numeric.parse(t, "intent")[2] == v, t
    for t, (r, i) in TWO.items():
        assert (numeric.parse(t)[2], numeric.parse(t, "intent")[2]) == (r, i), t
    for t in ("1,00", "1234,567", "0,000"):
        assert numeric.parse(t)[:2] == (False, "comma")
    for t in ("万", "十百", "x"):
        assert not numeric.parse(t)[0]
    with pytest.raises(ValueError):
        numeric.Parser("other")


def test_categories():
    c = chars.Categories()
    names = lambda ch: {n for n in chars.NAMES if c.mask(ch) & chars.BIT[n]}
    assert names("a") == {"ALPHA"} and names("é") == {"ALPHA"} and names("\n") == {"SPACE"} and names("5") == {"NUMERIC"}
    assert names("ー") == {"KATAKANA", "NOOOVBOW"} and names("々") == {"KANJI", "NOOOVBOW", "SYMBOL"}
    assert names("〇") == {"KANJI", "SYMBOL", "KANJINUMERIC"} and names("・") == {"NOOOVBOW"} and names("ா") == {"DEFAULT"}
    m = c.masks("ab1 々〇x")
    assert chars.run_ends(m) == [2, 2, 3, 4, 6, 6, 7]
    assert chars.can_begin(c.masks("ab1cЖд")) == [True, False, True, True, True, False]
    e = chars.run_ends(m)
    assert chars.span_mask(m, e, 0, 2) == chars.BIT["ALPHA"] and chars.span_mask(m, e, 1, 3) == 0
    assert chars.span_mask(m, e, 4, 6) == chars.BIT["KANJI"] | chars.BIT["SYMBOL"]


def test_normalize_with_offsets():
    n = normalize.Normalizer()
    assert len(normalize.REPLACE) == 182 and len(normalize.KEEP) == 835
    for text, want, at in [("ＡＢｃ", "abc", [0, 1, 2, 3]), ("ｶﾞｷ", "ガキ", [0, 2, 3]), ("㍿x", "株式会社x", [0, 0, 0, 0, 1, 2]), ("Ⅻ", "ⅻ", [0, 1]), ("", "", [0]), ("İ", "i", [0, 1]), ("ゔ", "ゔ", [0, 2])]:
        got = n(text)
        assert ("".join(got[0]), got[1]) == (want, at), text
        assert len(got[1]) == len(got[0]) + 1
    assert normalize.squeeze(list("aーー-b-"), list(range(7))) == (list("aーb-"), [0, 1, 4, 5, 6])
