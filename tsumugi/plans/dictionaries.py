"""Queries over dictionaries: lexicon and matrix files, compiled files, tries, settings, numerals, vocabularies."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import dictionary as dic
from ..operators.factory import FromFiles
from ..operators.morphemes import morphemes, tsv
from ..sources import binary, files
from . import registry as base

SIZES = (6000, 6000)
CREATED, ABOUT = 1_700_000_000, "seed words"
KEYS = ["電気", "電気通信", "電気通信大学", "電気通信大学大学院", "電気通信大学大学院大学"]
PROBES = [KEYS[-1], "あ" + KEYS[-1], "電気通信大", "通信", "電車", "大学電気通信大学大学院"]
#: numeral, value as meant, value with the two known oddities kept; written by hand
NUMERALS = [
    ("二千三百", "2300", "230000"), ("十五", "15", "15"), ("三万", "30000", "30000"), ("百二十三", "123", "1203"), ("千", "1000", "1000"), ("1.5", "1.5", None), ("1.5万", "15000", None),
    ("100", "100", "100"), ("〇", "0", "0"), ("12万3456", "123456", "123456"), ("二〇二四", "2024", "2024"), ("5百", "500", "500"), ("1,234.5", "1234.5", None), ("兆", None, None), ("1.", None, None),
    (".5", None, None), ("1,000万", "10000000", "10000000"), ("億", None, None), ("六三四", "634", "634"), ("十万五", "100005", "100005"), ("12,34", None, None),
]
TEXT = "東京都へ行く\n\n行った\r\n電気通信大学\r東京タワーへ行った"
SETTINGS = json.dumps(
    {
        "inputTextPlugin": [{"class": "a.b.DefaultInputTextPlugin"}, {"class": "ProlongedSoundMarkInputTextPlugin", "prolongedSoundMarks": ["ー", "-", "⁓", "〜", "〰"], "replacementSymbol": "ー"}],
        "oovProviderPlugin": [{"name": "MeCabOovProviderPlugin"}, {"name": "SimpleOovProviderPlugin", "oovPOS": ["補助記号", "一般", "*", "*", "*", "*"], "leftId": 5968, "rightId": 5968, "cost": 3857}],
        "pathRewritePlugin": [{"name": "JoinNumericPlugin"}, {"name": "JoinKatakanaOovPlugin", "oovPOS": ["名詞", "普通名詞", "一般", "*", "*", "*"], "minLength": 3}],
    }
)


@cache
def _raw() -> dic.Dictionary:
    """As `registry.seed`, costs of the user's words as they are written."""
    d = dic.Dictionary(dic.SYSTEM, dic.MATRIX)
    d.add(dic.USER)
    return d


@cache
def _files(folder: str) -> dict[str, str]:
    """The seed as source and compiled files, written once below a shared folder."""
    d = _raw()
    both = [binary.dump(binary.compiled(d, k, CREATED, ABOUT, SIZES)) for k in (0, 1)]
    cells = "\n".join([f"{SIZES[0]} {SIZES[1]}", *(f"{a} {b} {c}" for (a, b), c in dic.MATRIX.items()), "1 2", ""])
    parts = {"system.csv": "\n".join(dic.SYSTEM).encode(), "bad.csv": BAD.encode(), "matrix.def": cells.encode(), "system.dic": both[0], "user.dic": both[1], "text.txt": TEXT.encode(), "system16.dic": binary.convert(both[0], False, True)}
    for name, data in parts.items():
        files.put(f"{folder}/{name}", data)
    return {name: f"{folder}/{name}" for name in parts}


BAD = "\n".join(["a,1,2", ",1,1,1,a,p,p,p,p,p,p,r,n,*,A,*,*,*", "b,1,99999,1,b,p,p,p,p,p,p,r,n,*,A,*,*,*", "c,1,1,1,c,p,p,p,p,p,p,r,n,*,A,0/1,*,*", "\\u0064\\u{1F600},1,1,1,d,p,p,p,p,p,p,r,n,*,A,*,*,*", ""])


def seed_files(spark) -> dict[str, str]:
    return _files(files.shared(spark))


def lexicon_file(spark, sf_dir):
    return files.lexicon(spark, seed_files(spark)["system.csv"]).drop("id", "error")


def lexicon_errors(spark, sf_dir):
    return files.lexicon(spark, seed_files(spark)["bad.csv"]).select("headword", F.coalesce("error", F.lit("")).alias("error"))


def lexicon_pos_ids(spark, sf_dir):
    return files.pos_ids(files.lexicon(spark, seed_files(spark)["system.csv"]))


def matrix_file(spark, sf_dir):
    return files.matrix(spark, seed_files(spark)["matrix.def"])


WORDS = "dict_id int, word_id int, headword string, left_id int, right_id int, cost int, surface string, pos string, pos_id int, reading string, normalized string, form_id int, unit string, a string, b string, dictionary_form string"


def compiled_words(spark, paths: list[str], utf16: bool = False) -> DataFrame:
    """Words of compiled files, the system's first: each file is read by one task, which yields its words as rows."""
    pos = binary.parse(files.read(paths[0]), utf16).pos

    def run(frames):
        import pandas as pd

        for f in frames:
            for k, content in zip(f["path"], f["content"]):
                n = next(i for i, p in enumerate(paths) if k.endswith(p.rpartition("/")[2]))
                c = binary.parse(bytes(content), utf16, [] if n == 0 else pos)
                ref = lambda xs: "/".join(("U" if x & binary.OWN else "") + str(x & ~binary.OWN) for x in xs)
                rows = [(n, i, w.headword, w.left, w.right, w.cost, w.surface, ",".join(w.pos), p, w.reading, w.normalized, w.form_id, w.unit, ref(w.a), ref(w.b), w.dictionary_form) for i, (w, p) in enumerate(zip(c.words, c.pos_ids))]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in WORDS.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, WORDS)


def compiled_dictionary(spark, sf_dir):
    at = seed_files(spark)
    return compiled_words(spark, [at["system.dic"], at["user.dic"]])


def converted_dictionary(spark, sf_dir):
    return compiled_words(spark, [seed_files(spark)["system16.dic"]], utf16=True)


def printed_dictionary(spark, sf_dir):
    """Every word of the system dictionary as one line of 18 columns, as the printer of compiled files gives it."""
    return compiled_words(spark, [seed_files(spark)["system.dic"]]).select(
        "word_id", F.concat_ws(",", "surface", F.col("left_id").cast("string"), F.col("right_id").cast("string"), F.col("cost").cast("string"), "surface", "pos", "reading", "normalized", F.when(F.col("form_id") < 0, "*").otherwise(F.col("form_id").cast("string")), "unit", *[F.when(F.col(c) == "", "*").otherwise(F.col(c)) for c in "ab"], F.lit("*")).alias("line")
    )


def header_print(spark, sf_dir):
    """Headers of compiled files: only the first bytes of each are parsed."""
    at = seed_files(spark)

    def run(frames):
        import pandas as pd

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                h = binary.read_header(bytes(content[: 16 + binary.DESCRIPTION]))
                yield pd.DataFrame({"file": [path.rpartition("/")[2]], "type": [h.kind], "created": [h.created], "description": [h.description]})

    rows = spark.read.format("binaryFile").load([at["system.dic"], at["user.dic"]]).select("path", "content").mapInPandas(run, "file string, type string, created long, description string")
    return rows.select("file", "type", F.date_format(F.to_utc_timestamp(F.timestamp_seconds("created"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("create_time"), "description")


def trie_prefixes(spark, sf_dir):
    """Common-prefix search in a double array, at every place of each probe."""
    units = binary.build_trie([k.encode() for k in KEYS], list(range(len(KEYS)))).tobytes()  # five keys

    def run(frames):
        import numpy as np
        import pandas as pd

        u = np.frombuffer(units, np.uint32)
        for f in frames:
            rows = [(p, i, v, len(p.encode()[:end].decode())) for p in f["probe"] for i in range(len(p)) for v, end in binary.prefixes(u, p.encode(), len(p[:i].encode()))]
            yield pd.DataFrame(rows, columns=["probe", "at", "value", "end"])

    return spark.createDataFrame([(p,) for p in PROBES], "probe string").mapInPandas(run, "probe string, at int, value int, `end` int")


def _from_files(spark) -> FromFiles:
    at = seed_files(spark)
    return FromFiles(SETTINGS, at["system.dic"], (at["user.dic"],))


def settings_tokens(spark, sf_dir):
    """Morphemes by a tokenizer that workers build from settings and compiled files."""
    return morphemes(base.sentences(spark), _from_files(spark), "sent_id")


def text_file_tsv(spark, sf_dir):
    """A text file's lines as full TSV: every line ends with EOS, an empty one is EOS alone."""
    rows = tsv(files.lines(spark, seed_files(spark)["text.txt"]), _from_files(spark), "id", full=True)
    return rows.select(F.col("id").alias("line"), "text")


def numeral_values(spark, sf_dir):
    """Numerals with digits, Chinese digits, units, points and commas, in both ways of reading them."""

    @F.pandas_udf("string")
    def intent(s):
        return s.map(lambda x: numeric.parse(x, "intent")[2])

    @F.pandas_udf("string")
    def reference(s):
        return s.map(lambda x: numeric.parse(x, "reference")[2])

    return spark.createDataFrame([(n,) for n, _, _ in NUMERALS], "numeral string").select("numeral", intent("numeral").alias("as_meant"), reference("numeral").alias("with_oddities"))


def stages_dump(spark, sf_dir):
    """What analysis goes through for each sentence: text, path before and after rewriting (the lattice has queries)."""
    make = base.make_seed

    def run(frames):
        import pandas as pd

        t = make()
        for f in frames:
            rows = [(k, stage, b, e, s) for k, x in zip(f["sent_id"], f["text"]) for stage, b, e, s, _ in t.dump(x) if stage != "lattice"]
            yield pd.DataFrame(rows, columns=["sent_id", "stage", "begin", "end", "surface"])

    return base.sentences(spark).mapInPandas(run, "sent_id long, stage string, begin int, `end` int, surface string")


def edges_ending(spark, sf_dir):
    """Edges that end at each place of each sentence, without those of one span: filters on the rows of edges."""
    e = base.lattice_edges(spark).filter("seq <> 9999")
    return e.filter("NOT (begin = 0 AND end = 2)").groupBy("sent_id", "end").agg(F.count("*").alias("n_edges"), F.min("cost").alias("least"))


def _vocabulary(spark, sf_dir, name: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({base.WORD})"))
    return base.read(spark, sf_dir, name).select(F.explode(words).alias("word")).distinct()


def vocabulary_sets(spark, sf_dir):
    """Words of the benchmark and of conversations: union, intersection, differences."""
    a, b = _vocabulary(spark, sf_dir, "benchmark"), _vocabulary(spark, sf_dir, "conversations")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "benchmark only": a.exceptAll(b), "conversations only": b.subtract(a)}
    out = None
    for name, df in parts.items():
        rows = df.agg(F.count("*").alias("n_words"), F.sum(F.length("word")).cast("long").alias("n_chars")).withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def event_days(spark, sf_dir):
    """Events by day and hour of day: date functions over the stream table."""
    e = base.read(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.dayofweek("ts").isin(1, 7)).alias("n_weekend"))


def cost_statistics(spark, sf_dir):
    """Least, greatest and mean cost of words by part of speech, with the logarithm of their number."""
    x = base.seed_lexicon(spark)
    return x.groupBy("pos").agg(F.min("cost").alias("least"), F.max("cost").alias("greatest"), F.round(F.avg("cost"), 6).alias("mean"), F.round(F.log2(F.count("*") + F.lit(1)), 6).alias("bits"))


OWN = [
    lexicon_file, lexicon_errors, lexicon_pos_ids, matrix_file, compiled_dictionary, converted_dictionary, printed_dictionary, header_print, trie_prefixes, settings_tokens,
    text_file_tsv, numeral_values, stages_dump, edges_ending, vocabulary_sets, event_days, cost_statistics,
]


def queries() -> dict:
    return {f.__name__: f for f in OWN}


def _csv_ctes() -> str:
    """c: the seed's source rows, cut at commas in SQL; one row holds escapes, of a comma."""
    rows = [(d, i, x) for d, layer in enumerate((dic.SYSTEM, dic.USER)) for i, x in enumerate(layer)]
    get = lambda k: f"replace(c[{k}], '\\u002c', ',')"
    return f"""raw(dict_id, word_id, c) AS (SELECT d, i, string_split(x, ',') FROM (VALUES {base._values(rows)}) v(d, i, x)),
    c AS (SELECT dict_id, word_id, {get(1)} AS headword, c[2]::INT AS left_id, c[3]::INT AS right_id, c[4]::INT AS cost, {get(5)} AS surface, {', '.join(f'c[{6 + k}] AS p{k}' for k in range(6))}, array_to_string(c[6:11], ',') AS pos,
      {get(12)} AS reading, {get(13)} AS normalized, c[14] AS form_id, c[15] AS unit_type, c[16] AS a_split, c[17] AS b_split, c[18] AS word_structure FROM raw)"""


def _compiled_sql(layers: str) -> str:
    """Ids of parts of speech: the system's as first seen, then those that only the user's dictionary has."""
    return f"""WITH {_csv_ctes()}, q AS (SELECT pos, row_number() OVER (ORDER BY min(dict_id * 100000 + word_id)) - 1 AS pos_id FROM c GROUP BY pos)
    SELECT x.dict_id::INT AS dict_id, x.word_id::INT AS word_id, x.headword, x.left_id, x.right_id, x.cost, x.surface, x.pos, q.pos_id::INT AS pos_id, x.reading, x.normalized,
      (CASE x.form_id WHEN '*' THEN -1 ELSE x.form_id::INT END)::INT AS form_id, CASE WHEN x.a_split = '*' THEN 'A' WHEN x.b_split = '*' THEN 'B' ELSE 'C' END AS unit,
      replace(x.a_split, '*', '') AS a, replace(x.b_split, '*', '') AS b, coalesce(f.surface, x.surface) AS dictionary_form
    FROM c x JOIN q USING (pos) LEFT JOIN c f ON f.dict_id = x.dict_id AND f.word_id::VARCHAR = x.form_id WHERE x.dict_id IN ({layers})"""


def _full_sql(columns: str) -> str:
    """The cheapest of all paths of each sentence; runs of numerals are one morpheme with the value of their digits and
    ten thousands; ids of words, forms and readings from the seed's source rows."""
    value = "regexp_replace(CASE WHEN surface LIKE '%万%' THEN (coalesce(nullif(regexp_extract(surface, '^(\\d*)万', 1), ''), '1')::BIGINT * 10000 + coalesce(nullif(regexp_extract(surface, '万(\\d*)$', 1), ''), '0')::BIGINT)::VARCHAR ELSE surface END, '^$', '0')"
    return f"""WITH RECURSIVE {base._best_ctes()}, {_csv_ctes()},
    t AS (SELECT s.sent_id, s.k, s.b, s.e, s.surface, s.pos, s.normalized, s.dict_id, s.word_id, coalesce(f.surface, s.surface) AS form, s.reading, s.pos LIKE '%数詞%' AS num FROM s LEFT JOIN c x USING (dict_id, word_id) LEFT JOIN c f ON f.dict_id = s.dict_id AND f.word_id::VARCHAR = x.form_id),
    u AS (SELECT *, sum((NOT num OR NOT coalesce(before, false))::INT) OVER (PARTITION BY sent_id ORDER BY k) AS g FROM (SELECT *, lag(num) OVER (PARTITION BY sent_id ORDER BY k) AS before FROM t)),
    v AS (SELECT sent_id, g, count(*) AS n, min(b) AS b, max(e) AS e, string_agg(surface, '' ORDER BY k) AS surface, arg_min(pos, k) AS pos, string_agg(normalized, '' ORDER BY k) AS normalized, string_agg(form, '' ORDER BY k) AS form, string_agg(reading, '' ORDER BY k) AS reading, min(dict_id) AS dict_id, min(word_id) AS word_id FROM u GROUP BY sent_id, g),
    full_rows AS (SELECT sent_id::BIGINT AS sent_id, 0 AS line_no, (row_number() OVER (PARTITION BY sent_id ORDER BY g) - 1)::INT AS i, b::INT AS "begin", e::INT AS "end", surface, pos, CASE WHEN n > 1 THEN {value} ELSE normalized END AS normalized_form, form AS dictionary_form, reading AS reading_form, n = 1 AND dict_id < 0 AS is_oov, (CASE WHEN n > 1 THEN -1 ELSE dict_id END)::INT AS dictionary_id, (CASE WHEN n > 1 THEN -1 ELSE word_id END)::INT AS word_id, NULL::VARCHAR AS error FROM v)
    {columns}"""


def oracle_sql() -> dict[str, str]:
    lit, csv = base._values, f"WITH {_csv_ctes()}"
    words = f"unnest(regexp_extract_all(lower(text), '{base.WORD}')) AS word"
    edges = f'e(sent_id, seq, "begin", "end", left_id, right_id, cost, surface) AS (VALUES {lit(base._edges())})'
    lines = [(i, base.SENTENCES.index(x) if x else None) for i, x in enumerate(["東京都へ行く", "", "行った", "電気通信大学", "東京タワーへ行った"])]
    of = lambda part: f"SELECT count(*) AS n_words, sum(length(word))::BIGINT AS n_chars, '{part[0]}' AS part FROM ({part[1]})"
    return {
        "lexicon_file": f"{csv} SELECT headword, left_id, right_id, cost, surface, p0, p1, p2, p3, p4, p5, reading, normalized, form_id, unit_type, a_split, b_split, word_structure FROM c WHERE dict_id = 0",
        "lexicon_errors": "SELECT * FROM (VALUES ('a', '3 columns'), ('', 'empty headword'), ('b', 'not 16 bits'), ('c', 'a unit of type A has no splits'), ('d😀', '')) v(headword, error)",
        "lexicon_pos_ids": f"{csv} SELECT p0, p1, p2, p3, p4, p5, (row_number() OVER (ORDER BY min(word_id)) - 1)::INT AS pos_id FROM c WHERE dict_id = 0 GROUP BY p0, p1, p2, p3, p4, p5",
        "matrix_file": f'SELECT l::INT AS "left", r::INT AS "right", c::INT AS cost FROM (VALUES {lit([(a, b, c) for (a, b), c in dic.MATRIX.items()])}) v(l, r, c)',
        "compiled_dictionary": _compiled_sql("0, 1"),
        "converted_dictionary": _compiled_sql("0"),
        "printed_dictionary": f"SELECT word_id, concat_ws(',', surface, left_id, right_id, cost, surface, pos, reading, normalized, CASE WHEN form_id < 0 THEN '*' ELSE form_id::VARCHAR END, unit, CASE a WHEN '' THEN '*' ELSE a END, CASE b WHEN '' THEN '*' ELSE b END, '*') AS line FROM ({_compiled_sql('0')})",
        "header_print": f"SELECT file, type, strftime(make_timestamp({CREATED} * 1000000::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS create_time, '{ABOUT}' AS description FROM (VALUES ('system.dic', 'system dictionary'), ('user.dic', 'user dictionary')) v(file, type)",
        "trie_prefixes": f'SELECT probe, at::INT AS at, value::INT AS value, (at + length(key))::INT AS "end" FROM (SELECT probe, unnest(range(length(probe))) AS at FROM (VALUES {lit([(p,) for p in PROBES])}) v(probe)) p JOIN (VALUES {lit([(k, i) for i, k in enumerate(KEYS)])}) k(key, value) ON starts_with(substr(probe, at::INT + 1), key)'.replace(" at,", ' "at",').replace("AS at ", 'AS "at" ').replace("(at +", '("at" +').replace("SELECT probe, at::", 'SELECT probe, "at"::').replace("probe, at::INT + 1", 'probe, "at"::INT + 1'),
        "settings_tokens": _full_sql("SELECT * FROM full_rows"),
        "full_tokens": _full_sql("SELECT * FROM full_rows"),
        "text_file_tsv": _full_sql(f"SELECT line::BIGINT AS line, coalesce(string_agg(concat_ws(chr(9), surface, pos, normalized_form, dictionary_form, reading_form, dictionary_id, CASE WHEN is_oov THEN '(OOV)' END), chr(10) ORDER BY i) FILTER (surface IS NOT NULL) || chr(10), '') || 'EOS' AS text FROM (VALUES {lit(lines)}) l(line, sent) LEFT JOIN full_rows ON sent = sent_id GROUP BY line"),
        "numeral_values": f"SELECT numeral, as_meant, with_oddities FROM (VALUES {lit(NUMERALS)}) v(numeral, as_meant, with_oddities)",
        "stages_dump": _full_sql(f"SELECT sent_id, 'after rewriting' AS stage, \"begin\", \"end\", surface FROM full_rows UNION ALL SELECT sent_id::BIGINT, 'before rewriting', b::INT, e::INT, surface FROM s UNION ALL SELECT i::BIGINT, 'text', 0, length(x)::INT, x FROM (VALUES {lit(list(enumerate(base.SENTENCES)))}) z(i, x)"),
        "edges_ending": f'WITH {edges} SELECT sent_id::BIGINT AS sent_id, "end"::INT AS "end", count(*) AS n_edges, min(cost)::INT AS least FROM e WHERE seq <> 9999 AND NOT ("begin" = 0 AND "end" = 2) GROUP BY sent_id, "end"',
        "vocabulary_sets": f"WITH a AS (SELECT DISTINCT {words} FROM benchmark), b AS (SELECT DISTINCT {words} FROM conversations) " + " UNION ALL ".join(map(of, [("both", "FROM a WHERE word IN (FROM b)"), ("either", "FROM a UNION FROM b"), ("benchmark only", "FROM a WHERE word NOT IN (FROM b)"), ("conversations only", "FROM b WHERE word NOT IN (FROM a)")])),
        "event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, count(*) AS n, count(*) FILTER (dayofweek(ts) IN (0, 6)) AS n_weekend FROM events GROUP BY 1, 2",
        "cost_statistics": f"{csv}, x AS (SELECT pos, CASE WHEN cost = -32768 THEN (SELECT cost FROM ({base._auto_cost_sql()}) k WHERE k.headword = c.headword) ELSE cost END AS cost FROM c) SELECT pos, min(cost)::INT AS least, max(cost)::INT AS greatest, round(avg(cost), 6) AS mean, round(log2(count(*) + 1), 6) AS bits FROM x GROUP BY pos",
    }
