"""Queries that run the operators themselves over literal texts; the SQL lists the rows they must give, written by hand
or derived in SQL from the definition tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions import chars, normalize
from ..operators import dictionary as dic
from ..operators.tokenize import NoMorpheme, Tokenizer
from ..sources.definitions import PROPERTIES, UNKNOWN, Settings
from . import registry as base

#: text, normalised, place in the text of each character and of the end
OFFSETS = [
    ("ＡＢＣ", "abc", "0 1 2 3"), ("㍿a", "株式会社a", "0 0 0 0 1 2"), ("カ゛ギ", "ガギ", "0 2 3"), ("xﾊﾟ", "xパ", "0 1 3"), ("①②", "12", "0 1 2"), ("Ⅻ", "ⅻ", "0 1"), ("ｱｲｽ", "アイス", "0 1 2 3"),
    ("½x", "1⁄2x", "0 0 0 1 2"), ("スーーパー", "スーパー", "0 1 3 4 5"), ("ゴ〜〜ル-", "ゴール-", "0 1 3 4 5"), ("⽂⼀", "⽂⼀", "0 1 2"), ("", "", "0"), ("ÀÉß", "àéß", "0 1 2 3"), ("か゛ー-", "がー", "0 2 4"), ("İ", "i", "0 1"),
]
#: text, place, categories, end of the run, can a word begin here, categories of the span to the run's end
PLACES = [
    ("ab12漢字", 0, "ALPHA", 2, True, "ALPHA"), ("ab12漢字", 1, "ALPHA", 2, False, "ALPHA"), ("ab12漢字", 2, "NUMERIC", 4, True, "NUMERIC"), ("ab12漢字", 3, "NUMERIC", 4, True, "NUMERIC"), ("ab12漢字", 4, "KANJI", 6, True, "KANJI"), ("ab12漢字", 5, "KANJI", 6, True, "KANJI"),
    ("一二x", 0, "KANJI KANJINUMERIC", 2, True, "KANJI KANJINUMERIC"), ("一二x", 1, "KANJI KANJINUMERIC", 2, True, "KANJI KANJINUMERIC"), ("一二x", 2, "ALPHA", 3, True, "ALPHA"),
    ("ャカ。", 0, "KATAKANA NOOOVBOW", 2, True, "KATAKANA"), ("ャカ。", 1, "KATAKANA", 2, True, "KATAKANA"), ("ャカ。", 2, "SYMBOL", 3, True, "SYMBOL"),
    ("αβа", 0, "GREEK", 2, True, "GREEK"), ("αβа", 1, "GREEK", 2, False, "GREEK"), ("αβа", 2, "CYRILLIC", 3, True, "CYRILLIC"), ("一字", 0, "KANJI KANJINUMERIC", 2, True, "KANJI"), ("一字", 1, "KANJI", 2, True, "KANJI"),
]
WORDS = [dic._row("漢字", 5139, 3000, dic.NOUN, "カンジ"), dic._row("アイ", 5139, 900, dic.NOUN, "アイ"), dic._row("スキ", 5139, 900, dic.NOUN, "スキ"), dic._row("字", -1, 10, dic.NOUN, "ジ")]
PROPOSED = ["漢字アイ", "字", "あいう", "ab1", "ャカ"]
#: text, unknown-word providers and rewriters, surface/normalised form/(OOV) of each morpheme, or the error
PATHS = [
    ("1,234", "mecab numeric", "1,234=1234"), ("1,23", "mecab numeric", "1=1 ,=, 2=2 3=3"), ("二千三百", "mecab numeric", "二千三百=230000"), ("3.5", "mecab numeric", "3=3 .=. 5=5"), ("12万", "mecab numeric", "12万=120000"), ("12万", "mecab", "1=1 2=2 万=万"),
    ("東京1", "mecab numeric", "東京=東京 1=1"), ("アイスキ", "mecab katakana", "アイスキ=アイスキ?"), ("アイスキ", "mecab", "アイ=アイ スキ=スキ"), ("漢字", "simple", "漢字=漢字"), ("林森", "simple", "林=林? 森=森?"), ("ab", "simple", "the end isn't reached"), ("林a", "simple mecab", "林=林? a=a?"),
    ("12", "mecab numeric", "12=12"), ("7,", "mecab numeric", "7=7 ,=,"), ("〇一", "mecab numeric", "〇一=01"), ("東京タワー", "mecab katakana", "東京タワー=東京タワー"),
]
JSON = '{"Path": "/usr/share/words", "systemDict": "system.dic", "characterDefinitionFile": "/etc/char.def", "userDict": ["u1.dic", "/u2.dic"], "inputTextPlugin": [{"class": "x.A"}, {"name": "B", "class": "x.C"}], "oovProviderPlugin": [{"class": "D"}], "other": 1}'


def normalized_offsets(spark, sf_dir):
    @F.pandas_udf("struct<normalized:string,places:string>")
    def run(s):
        import pandas as pd

        n, rows = normalize.Normalizer(), []
        for x in s:
            cs, places = normalize.squeeze(*n(x))
            rows.append(("".join(cs), " ".join(map(str, places))))
        return pd.DataFrame(rows, columns=["normalized", "places"])

    return spark.createDataFrame([(t,) for t, _, _ in OFFSETS], "text string").withColumn("n", run("text")).select("text", "n.normalized", "n.places")


def category_places(spark, sf_dir):
    """Categories, runs, places where words begin, and common categories of spans, per character."""

    def run(frames):
        import pandas as pd

        c = chars.Categories()
        said = lambda m: " ".join(sorted(n for n in chars.NAMES if m & chars.BIT[n]))
        for f in frames:
            rows = []
            for t in f["text"]:
                masks = c.masks(t)
                ends, begins = chars.run_ends(masks), chars.can_begin(masks)
                rows += [(t, i, said(masks[i]), ends[i], begins[i], said(chars.span_mask(masks, ends, i, ends[i]))) for i in range(len(t))]
            yield pd.DataFrame(rows, columns=["text", "place", "categories", "run_end", "can_begin", "span_categories"])

    texts = list(dict.fromkeys(p[0] for p in PLACES))
    return spark.createDataFrame([(t,) for t in texts], "text string").mapInPandas(run, "text string, place int, categories string, run_end int, can_begin boolean, span_categories string")


@cache
def _words() -> dic.Dictionary:
    return dic.Dictionary(WORDS, {(5139, 5139): 1})


def unknown_proposals(spark, sf_dir):
    """Edges of unknown words in the lattices of literal texts, with the words that keep some of them away."""

    def run(frames):
        import pandas as pd

        t = Tokenizer(_words(), rewrite=())
        for f in frames:
            rows = [(x, e.begin, e.end, e.cost, ",".join(e.pos)) for x in f["text"] for e in t.lattice(x)[2] if e.oov]
            yield pd.DataFrame(rows, columns=["text", "begin", "end", "cost", "pos"])

    return spark.createDataFrame([(t,) for t in PROPOSED], "text string").mapInPandas(run, "text string, begin int, `end` int, cost int, pos string")


def _merged() -> dic.Dictionary:
    """The seed with the user's words, and the words above as one more user dictionary."""
    d = dic.Dictionary(dic.SYSTEM, dic.MATRIX)
    d.add(dic.USER, base.auto_cost)
    d.add(WORDS)
    return d


def rewritten_paths(spark, sf_dir):
    """Paths of literal texts, with some providers of unknown words and rewriters each."""

    def run(frames):
        import pandas as pd

        made: dict = {}
        for f in frames:
            rows = []
            for x, how in zip(f["text"], f["how"]):
                if how not in made:
                    made[how] = Tokenizer(_merged(), oov=tuple(h for h in how.split() if h in ("mecab", "simple")), rewrite=tuple(h for h in how.split() if h in ("numeric", "katakana")))
                try:
                    said = " ".join(f"{m[2]}={m[4]}" + "?" * m[7] for m in made[how].tokenize(x))
                except NoMorpheme as e:
                    said = str(e)
                rows.append((x, how, said))
            yield pd.DataFrame(rows, columns=["text", "how", "path"])

    return spark.createDataFrame([p[:2] for p in PATHS], "text string, how string").mapInPandas(run, "text string, how string, path string")


def settings_rows(spark, sf_dir):
    s = Settings.parse(JSON).then(Settings.parse('{"userDict": ["u3.dic"], "pathRewritePlugin": []}', "/late"))
    rows = [("path", s.path), ("system", s.system_dict), ("characters", s.char_def), ("users", " ".join(s.user_dict)), ("texts", " ".join(p["kind"] for p in s.text_plugins)), ("unknown", " ".join(p["kind"] for p in s.oov_plugins)), ("paths", str(len(s.path_plugins))), ("costs", str(s.cost_plugins))]
    return spark.createDataFrame(rows, "setting string, value string")


OWN = [normalized_offsets, category_places, unknown_proposals, rewritten_paths, settings_rows]


def queries() -> dict:
    return {f.__name__: f for f in OWN}


def oracle_sql() -> dict[str, str]:
    lit = base._values
    #: texts as runs: text, begin and end of the run, its category, and whether the run's first place bars unknown words
    runs = [("漢字アイ", 0, 2, "KANJI"), ("漢字アイ", 2, 4, "KATAKANA"), ("字", 0, 1, "KANJI"), ("あいう", 0, 3, "HIRAGANA"), ("ab1", 0, 2, "ALPHA"), ("ab1", 2, 3, "NUMERIC"), ("ャカ", 0, 2, "KATAKANA")]
    #: places where a word of the dictionary begins; places where none can begin
    words, never = [("漢字アイ", 0), ("漢字アイ", 2)], [("ab1", 1), ("漢字アイ", 1)]
    return {
        "normalized_offsets": f"SELECT * FROM (VALUES {lit(OFFSETS)}) v(text, normalized, places)",
        "category_places": f"SELECT text, place::INT AS place, categories, run_end::INT AS run_end, can_begin, span_categories FROM (VALUES {lit(PLACES)}) v(text, place, categories, run_end, can_begin, span_categories)",
        "unknown_proposals": f"""WITH r(text, b, e, category) AS (VALUES {lit(runs)}), p(category, always, whole, longest) AS (VALUES {lit([(k, *v) for k, v in PROPERTIES.items()])}),
          u(category, cost, pos) AS (VALUES {lit([(c, cost, ",".join(x)) for c, _, _, cost, x in UNKNOWN])}), w(text, at_) AS (VALUES {lit(words)}), n(text, at_) AS (VALUES {lit(never)}),
          s AS (SELECT r.*, unnest(range(b, e)) AS at_ FROM r), t AS (SELECT s.*, always, whole, longest, w.at_ IS NOT NULL AS has FROM s JOIN p USING (category) LEFT JOIN w USING (text, at_) WHERE (text, at_) NOT IN (SELECT (text, at_) FROM n)),
          g AS (SELECT text, at_, e AS stop, category FROM t WHERE whole = 1 AND (always = 1 OR NOT has) UNION SELECT text, at_, at_ + k, category FROM (SELECT *, unnest(range(1, longest + 1)) AS k FROM t) WHERE (always = 1 OR NOT has) AND at_ + k <= e)
          SELECT text, at_::INT AS "begin", stop::INT AS "end", cost::INT AS cost, pos FROM g JOIN u USING (category)""",
        "rewritten_paths": f"SELECT * FROM (VALUES {lit(PATHS)}) v(text, how, path)",
        "settings_rows": "SELECT * FROM (VALUES ('path', '/late'), ('system', '/usr/share/words/system.dic'), ('characters', '/etc/char.def'), ('users', '/usr/share/words/u1.dic /u2.dic /late/u3.dic'), ('texts', 'A B'), ('unknown', 'D'), ('paths', '0'), ('costs', 'None')) v(setting, value)",
    }
