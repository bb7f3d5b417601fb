"""Queries by name, with the SQL that returns the same rows."""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, normalize, numeric
from ..operators import dictionary as dic
from ..operators.morphemes import morphemes, spread, tsv
from ..operators.tokenize import Tokenizer, auto_cost
from ..sources.definitions import PROPERTIES, UNKNOWN

WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
SENTENCES = ["東京都へ行く", "電気通信大学", "電気通信大学の大学院", "行った", "東京タワーへ行った", "12万3456", "アイスクリーム", "東京都の東京", "a1 東京"]
NUMERALS = ["1,000", "12,345,678", "007", "42", "1,234,567", "999", "1,00", "1234,567", "0,000", "12,34"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latin_rows(words: list[str]) -> list[str]:
    return [dic._row(w, 5139, 3000 + 100 * len(w), dic.NOUN, w) for w in words]


class Latin:
    """Makes a tokenizer over words of the benchmark table; the words travel with the task, their number is bounded by
    that table's vocabulary, and equal makers share one tokenizer per worker."""

    def __init__(self, words: tuple[str, ...]):
        self.words = words

    def __hash__(self):
        return hash(self.words)

    def __eq__(self, other):
        return isinstance(other, Latin) and self.words == other.words

    def __call__(self) -> Tokenizer:
        return Tokenizer(dic.Dictionary(latin_rows(list(self.words))), marks=(), rewrite=())


def latin(spark: SparkSession, sf_dir: str) -> Latin:
    words = lexicon(spark, sf_dir).orderBy("headword").collect()
    return Latin(tuple(r.headword for r in words))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))).alias("headword")).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def tokens(spark: SparkSession, sf_dir: str, columns=None, keep=()) -> DataFrame:
    return morphemes(documents(spark, sf_dir), latin(spark, sf_dir), "doc_id", columns=columns, keep=keep)


TOKENS = ["line_no", "i", "begin", "end", "surface", "pos", "normalized_form", "is_oov"]


def tokens_mode_c(spark, sf_dir):
    return tokens(spark, sf_dir, TOKENS)


# --- SQL pieces shared by the oracles
def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@cache
def _classes() -> list[tuple[str, str]]:
    """(category, regex class) of the ASCII and Latin-1 part of the table, where each character has one category."""
    c, by = chars.Categories(), {}
    for cp in range(1, 256):
        by.setdefault(c.mask(chr(cp)), []).append(cp)
    return [(next(n for n in chars.NAMES if chars.BIT[n] == m), "[" + "".join(f"\\x{{{x:x}}}" for x in cps) + "]") for m, cps in sorted(by.items())]


def _lines() -> str:
    return r"""lines AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no, len(a) AS n
      FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS a FROM documents)) WHERE line <> '' OR line_no < n - 1)"""


def _runs() -> str:
    any_run = "|".join(f"{c}+" for _, c in _classes())
    return f"""{_lines()}, runs AS (SELECT *, (sum(length(run)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(run))::INT AS "begin"
      FROM (SELECT doc_id, line_no, unnest(a) AS run, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{any_run}') AS a FROM lines)))"""


def _tokens() -> str:
    """Each run takes its cheapest alternative: a headword that is the whole run, or the cheapest unknown word."""
    best = {}
    for cat, _, _, cost, pos in UNKNOWN:
        if cat not in best or cost < best[cat][0]:
            best[cat] = (cost, ",".join(pos))
    case = " ".join(f"WHEN regexp_full_match(r.run, '{c}+') THEN '{best[n][1]}'" for n, c in _classes())
    return f"""{_runs()}, lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS headword FROM benchmark),
      tokens AS (SELECT r.doc_id, r.line_no::INT AS line_no, (r.k - 1)::INT AS i, r."begin", (r."begin" + length(r.run))::INT AS "end", r.run AS surface,
        CASE WHEN headword IS NOT NULL THEN '{dic.NOUN}' ELSE CASE {case} END END AS pos, lower(r.run) AS normalized_form, headword IS NULL AS is_oov
        FROM runs r LEFT JOIN lex ON lower(r.run) = headword AND 3000 + 100 * length(headword) < 11633)"""


# --- queries over documents
def line_split(spark, sf_dir):
    d = spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.split("text", r"\r\n|\r|\n", -1).alias("a"))
    rows = d.select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("line_no", "line"))
    return rows.filter((F.col("line") != "") | (F.col("line_no") < F.col("n") - 1)).select("doc_id", "line_no", "line")


def char_category_histogram(spark, sf_dir):
    per = documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    table = F.broadcast(spark.createDataFrame(chars.ranges(), "low int, high int, bits int"))  # as many rows as the table has
    cp = per.withColumn("cp", F.ascii("ch"))
    masks = cp.join(table, F.col("cp").between(F.col("low"), F.col("high")), "left").groupBy("ch", "n").agg(F.coalesce(F.bit_or("bits"), F.lit(1)).alias("mask"))
    return masks.groupBy("mask").agg(F.sum("n").cast("long").alias("n_chars"))


def normalized_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.lower("text"), "[-ー⁓〜〰]{2,}", "ー").alias("normalized"))


_JAVA = {n: c for n, c in _classes()}


def _spark_runs(spark, sf_dir):
    lines = line_split(spark, sf_dir)
    pattern = "(" + "|".join(f"{c}+" for _, c in _classes()) + ")"
    return lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(pattern))).alias("k", "run"))


def category_runs(spark, sf_dir):
    runs = _spark_runs(spark, sf_dir)
    cat = F.coalesce(*[F.when(F.col("run").rlike(f"^{c}"), F.lit(n)) for n, c in _classes()])
    return runs.groupBy("doc_id", cat.alias("category")).agg(F.count("*").alias("n_runs"), F.sum(F.length("run")).cast("long").alias("n_chars"), F.max(F.length("run")).cast("long").alias("longest"))


def word_begin_positions(spark, sf_dir):
    """Places where a word may begin, per document: the first character of a run of letters, and every other character."""
    alpha = _JAVA["ALPHA"]
    d = line_split(spark, sf_dir)
    begins = F.regexp_count("line", F.lit(f"{alpha}+")) + F.length(F.regexp_replace("line", f"{alpha}", ""))
    return d.groupBy("doc_id").agg(F.sum(begins).cast("long").alias("n_begins"))


def prefix_matches(spark, sf_dir):
    """Headwords that are prefixes of the text where a run of letters begins. Lengths are exploded first, so the join
    is on equality; the lexicon side is broadcast by the planner's own threshold."""
    lex = lexicon(spark, sf_dir)
    runs = _spark_runs(spark, sf_dir).filter(F.col("run").rlike(f"^{_JAVA['ALPHA']}")).select(F.lower("run").alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    most = lex.agg(F.max(F.length("headword"))).first()[0] or 0
    probes = runs.select("run", "n", F.explode(F.sequence(F.lit(1), F.least(F.length("run"), F.lit(most)))).alias("k")) if most else runs.withColumn("k", F.lit(0))
    return probes.withColumn("headword", F.expr("substring(run, 1, k)")).join(lex, "headword").groupBy("headword").agg(F.sum("n").cast("long").alias("n_matches"))


def oov_candidates(spark, sf_dir):
    """Proposals for unknown words: every run once per row of its category."""
    per = category_runs(spark, sf_dir).groupBy("category").agg(F.sum("n_runs").cast("long").alias("n"))
    unk = spark.createDataFrame([(c, cost, ",".join(p)) for c, _, _, cost, p in UNKNOWN if PROPERTIES[c][1]], "category string, cost int, pos string")
    return per.join(F.broadcast(unk), "category").select("category", "pos", "cost", F.col("n").alias("n_candidates"))


def morpheme_tsv(spark, sf_dir):
    return tsv(documents(spark, sf_dir), latin(spark, sf_dir), "doc_id")


def pos_frequency(spark, sf_dir):
    return tokens(spark, sf_dir, ["pos"]).groupBy("pos").agg(F.count("*").alias("n"))


def pos_rollup(spark, sf_dir):
    return tokens(spark, sf_dir, ["pos"], ["lang"]).rollup("lang", "pos").agg(F.count("*").cast("long").alias("n"))


def top_terms_by_lang(spark, sf_dir):
    """The ten most frequent words of each language; counts come before the window, which ranks distinct words."""
    from pyspark.sql import Window

    per = tokens(spark, sf_dir, ["normalized_form", "pos"], ["lang"]).filter(F.col("pos") == dic.NOUN).groupBy("lang", "normalized_form").agg(F.count("*").cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "normalized_form"))
    return per.withColumn("rank", rank.cast("long")).filter("rank <= 10")


def oov_rate_by_source(spark, sf_dir):
    rows = tokens(spark, sf_dir, ["is_oov"], ["source"]).groupBy("source").agg(F.count("*").cast("long").alias("n_tokens"), F.count_if("is_oov").cast("long").alias("n_oov"))
    return rows.withColumn("oov_rate", F.col("n_oov") / F.col("n_tokens"))


def toxic_label_terms(spark, sf_dir):
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    rows = morphemes(documents(spark, sf_dir).join(toxic, "doc_id", "left_semi"), latin(spark, sf_dir), "doc_id", columns=["normalized_form", "pos"])
    return rows.filter(F.col("pos") == dic.NOUN).groupBy("normalized_form").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


# --- queries over sentences and the seed dictionary
@cache
def seed() -> dic.Dictionary:
    d = dic.Dictionary(dic.SYSTEM, dic.MATRIX)
    d.add(dic.USER, auto_cost)
    return d


def make_seed(**how) -> Tokenizer:
    return Tokenizer(seed(), **how)


def sentences(spark, _=None):
    return spark.createDataFrame(list(enumerate(SENTENCES)), "sent_id long, text string")


def tokens_by_mode(mode: str, spark, sf_dir):
    return morphemes(sentences(spark), partial(make_seed, rewrite=()), "sent_id", mode=mode, columns=["i", "begin", "end", "surface", "pos", "reading_form"])


def _edges(dictionary=None, texts=SENTENCES) -> list[tuple]:
    return [e[:8] for e in _word_edges(dictionary, texts)]


def _word_edges(dictionary=None, texts=SENTENCES) -> list[tuple]:
    """Edges, then what their words are: part of speech, reading, normalised form, dictionary and word id (-1: unknown)."""
    t, out = Tokenizer(dictionary or seed(), rewrite=()), []
    for k, s in enumerate(texts):
        text, _ = t.text(s)
        for q, e in enumerate(t.lattice(text)[2]):
            out.append((k, q, e.begin, e.end, e.left, e.right, e.cost, e.surface, ",".join(e.pos), e.reading, e.normalized, *(e.wid or (-1, -1))))
        out.append((k, 9999, len(text), len(text) + 1, 0, 0, 0, "EOS", "", "", "", -1, -1))
    return out


EDGE = "sent_id long, seq int, begin int, end int, left_id int, right_id int, cost int, surface string"


def lattice_edges(spark, dictionary=None):
    return spark.createDataFrame(_edges(dictionary), EDGE)


def best_path(spark, _=None, dictionary=None):
    """Least-cost path of each sentence from rows of edges; a sentence is a group, its edges are bounded by its length."""
    matrix = dict((dictionary or seed()).matrix)

    def run(pdf):
        import pandas as pd

        ending, back = {0: [(0, 0, None)]}, {}
        for r in pdf.sort_values(["begin", "seq"]).itertuples():
            low = None
            for total, right, prev in ending.get(r.begin, ()):
                c = matrix.get((right, r.left_id), 0)
                if c != 32767 and (low is None or total + c < low[0]):
                    low = (total + c, prev)
            if low:
                back[r.seq] = (low[1], r.surface)
                ending.setdefault(r.end, []).append((low[0] + r.cost, r.right_id, r.seq))
        if 9999 not in back:
            return pd.DataFrame({"sent_id": [], "total": [], "path": []}).astype({"sent_id": "int64", "total": "int64", "path": "str"})
        path, k = [], back[9999][0]
        while k is not None:
            path.append(back[k][1])
            k = back[k][0]
        total = min(t for t, _, s in ending[int(pdf["end"].max())] if s == 9999)
        return pd.DataFrame({"sent_id": [int(pdf["sent_id"].iloc[0])], "total": [int(total)], "path": ["/".join(path[::-1])]})

    return lattice_edges(spark, dictionary).groupBy("sent_id").applyInPandas(run, "sent_id long, total long, path string")


def _best_ctes(dictionary=None, texts=SENTENCES) -> str:
    """e: all edges; f: every path to the end, as a list of edges. Ids that no connection names are one id, so that only
    one edge of each span and pair of ids is followed."""
    d = dictionary or seed()
    named = {x for pair in d.matrix for x in pair}
    low: dict[tuple, tuple] = {}
    rows = _word_edges(d, texts)
    for k, q, b, e, le, r, c, *_ in rows:
        key = (k, b, e, le if le in named else 0, r if r in named else 0)
        if key not in low or (c, q) < low[key]:
            low[key] = (c, q)
    few = [(k, q, b, e, le, r, c) for (k, b, e, le, r), (c, q) in low.items()]
    return f"""w(sent_id, seq, b, e, l, r, cost, surface, pos, reading, normalized, dict_id, word_id) AS (VALUES {_values(rows)}),
    e(sent_id, seq, b, e, l, r, cost) AS (VALUES {_values(few)}),
    m(r, l, c) AS (VALUES {_values([(a, b, c) for (a, b), c in d.matrix.items()])}),
    p(sent_id, place, r, total, path) AS (
      SELECT DISTINCT sent_id, 0, 0, 0::BIGINT, []::INT[] FROM e
      UNION ALL
      SELECT e.sent_id, e.e, e.r, p.total + e.cost + coalesce(m.c, 0), CASE WHEN e.seq = 9999 THEN p.path ELSE list_append(p.path, e.seq) END
      FROM p JOIN e ON e.sent_id = p.sent_id AND e.b = p.place LEFT JOIN m ON m.r = p.r AND m.l = e.l WHERE coalesce(m.c, 0) <> 32767),
    f AS (SELECT p.sent_id, min(p.total) AS total, arg_min(p.path, p.total) AS path FROM p JOIN (SELECT sent_id, max(e) AS n FROM e GROUP BY sent_id) z ON z.sent_id = p.sent_id AND z.n = p.place GROUP BY p.sent_id),
    s AS (SELECT f.sent_id, f.total, k, w.* EXCLUDE (sent_id) FROM (SELECT sent_id, total, unnest(path) AS seq, generate_subscripts(path, 1) AS k FROM f) f JOIN w USING (sent_id, seq))"""


def _best_sql(dictionary=None) -> str:
    return f"WITH RECURSIVE {_best_ctes(dictionary)} SELECT sent_id::BIGINT AS sent_id, any_value(total)::BIGINT AS total, string_agg(surface, '/' ORDER BY k) AS path FROM s GROUP BY sent_id"


def _mode_sql(mode: str) -> str:
    """The morphemes of each sentence: the cheapest of all its paths, words with several units in this mode parted."""
    units = {"A": "x.a", "B": "x.b", "C": "''"}[mode]
    return f"""WITH RECURSIVE {_best_ctes()}, {_LEX_SQL.format(_values(_lexicon_rows()))},
      g AS (SELECT s.*, string_split({units}, '/') AS refs FROM s LEFT JOIN lex x USING (dict_id, word_id)),
      h AS (SELECT sent_id, k, 1 AS j, b, e, surface, pos, reading FROM g WHERE refs IS NULL OR len(refs) < 2
        UNION ALL SELECT g.sent_id, g.k, g.j, g.b, NULL, x.headword, x.pos, x.reading FROM (SELECT *, unnest(refs) AS ref, generate_subscripts(refs, 1) AS j FROM g WHERE len(refs) > 1) g JOIN lex x ON g.ref = x.dict_id || ':' || x.word_id),
      i AS (SELECT *, b + coalesce(sum(length(surface)) OVER (PARTITION BY sent_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM h)
    SELECT sent_id::BIGINT AS sent_id, (row_number() OVER (PARTITION BY sent_id ORDER BY k, j) - 1)::INT AS i, first::INT AS "begin", coalesce(e, first + length(surface))::INT AS "end", surface, pos, reading AS reading_form FROM i"""


def _auto_cost_sql() -> str:
    words = [w.headword for w in seed().layers[1]]
    raw = [(i, w, int(row.split(",")[3])) for i, (w, row) in enumerate(zip(words, dic.USER))]
    return f"""WITH RECURSIVE {_best_ctes(dic.Dictionary(dic.SYSTEM, dic.MATRIX), words)}, c AS (SELECT sent_id, arg_max(cost, k) - arg_min(cost, k) - 20 * count(*) AS auto FROM s GROUP BY sent_id)
    SELECT i::INT AS word_id, headword, (CASE WHEN said = -32768 THEN greatest(-32768, least(32767, auto)) ELSE said END)::INT AS cost FROM (VALUES {_values(raw)}) v(i, headword, said) JOIN c ON i = sent_id"""


@cache
def _inhibited() -> dic.Dictionary:
    d = dic.Dictionary(dic.SYSTEM, dic.MATRIX)
    d.inhibit(4791, 100)
    return d


def span_min_edge(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("sent_id", "begin", "end").orderBy("cost", "seq")
    return lattice_edges(spark).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("sent_id", "begin", "end", "cost", "surface")


def edge_connections(spark, sf_dir):
    e = lattice_edges(spark)
    m = spark.createDataFrame([(a, b, c) for (a, b), c in seed().matrix.items()], "r int, l int, c int")  # broadcast by the planner's own threshold
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.sent_id") == F.col("b.sent_id")) & (F.col("a.end") == F.col("b.begin")))
    pairs = pairs.join(m, (F.col("a.right_id") == F.col("r")) & (F.col("b.left_id") == F.col("l")), "left")
    return pairs.groupBy("a.sent_id").agg(F.count("*").alias("n_pairs"), F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("sum_cost"))


LEX = "dict_id int, word_id int, headword string, left_id int, cost int, surface string, pos string, reading string, normalized string, form_id int, a string, b string"


def _lexicon_rows() -> list[tuple]:
    ref = lambda xs: "/".join(f"{d}:{i}" for d, i in xs)
    return [(d, i, w.headword, w.left, w.cost, w.surface, ",".join(w.pos), w.reading, w.normalized, w.form_id, ref(w.a), ref(w.b)) for d, layer in enumerate(seed().layers) for i, w in enumerate(layer)]


def seed_lexicon(spark):
    return spark.createDataFrame(_lexicon_rows(), LEX)


_LEX_SQL = "lex(dict_id, word_id, headword, left_id, cost, surface, pos, reading, normalized, form_id, a, b) AS (VALUES {})"


def word_info(spark, sf_dir):
    x = seed_lexicon(spark)
    f = x.select(F.col("dict_id").alias("d"), F.col("word_id").alias("w"), F.col("surface").alias("dictionary_form"))
    return x.join(f, (F.col("dict_id") == F.col("d")) & (F.col("form_id") == F.col("w")), "left").select("dict_id", "word_id", "surface", F.coalesce("dictionary_form", "surface").alias("dictionary_form"), "reading", "normalized")


def word_id_lookup(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("surface", "pos", "reading").orderBy((F.col("dict_id") == 0).cast("int"), "dict_id", "word_id")
    return seed_lexicon(spark).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("surface", "pos", "reading", "dict_id", "word_id")


def dictionary_print(spark, sf_dir):
    unit = F.when(F.col("a") == "", "A").when(F.col("b") == "", "B").otherwise("C")
    line = F.concat_ws(",", "surface", F.col("left_id").cast("string"), F.col("cost").cast("string"), "pos", "reading", "normalized", unit, F.when(F.col("a") == "", "*").otherwise(F.col("a")))
    return seed_lexicon(spark).select("dict_id", "word_id", line.alias("line"), unit.alias("unit"))


def split_units(spark, sf_dir):
    """Units of every word with a split, with their places: references exploded and joined to the lexicon."""
    from pyspark.sql import Window

    x = seed_lexicon(spark)
    parts = x.filter("a <> ''").select("dict_id", "word_id", "headword", F.posexplode(F.split("a", "/")).alias("k", "ref"))
    unit = x.select(F.concat_ws(":", F.col("dict_id").cast("string"), F.col("word_id").cast("string")).alias("ref"), F.col("headword").alias("unit"))
    w = Window.partitionBy("dict_id", "word_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(unit, "ref").withColumn("begin", F.coalesce(F.sum(F.length("unit")).over(w), F.lit(0)).cast("long")).select("dict_id", "word_id", "headword", F.col("k").cast("long").alias("k"), "unit", "begin")


def user_auto_cost(spark, sf_dir):
    return spark.createDataFrame([(i, w.headword, w.cost) for i, w in enumerate(seed().layers[1])], "word_id int, headword string, cost int")


def numeric_values(spark, sf_dir):
    @F.pandas_udf("string")
    def value(s):
        return s.map(lambda x: numeric.parse(x)[2])

    return spark.createDataFrame([(x,) for x in NUMERALS], "numeral string").withColumn("value", value("numeral"))


def normalized_literals(spark, sf_dir):
    rows = ["ＡＢＣ", "ｶﾞｷﾞ", "㍿", "Ⅻ", "カ゛", "ﾊﾟﾋﾟ", "①②", "ｱｲｽ"]
    n = normalize.Normalizer()
    table = [(c, "".join(n(c)[0])) for c in sorted({x for r in rows for x in r}) if len(c) == 1]
    pairs = [(k, v) for k, v in n.replace.items() if any(k in r for r in rows)]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, text string")
    m = F.create_map(*[F.lit(x) for kv in table + pairs for x in kv])
    parts = F.regexp_extract_all("text", F.lit("(" + "|".join([k for k, _ in pairs] + ["."]) + ")"))
    return d.select("id", F.array_join(F.transform(parts, lambda p: F.coalesce(m[p], p)), "").alias("normalized"))


def full_tokens(spark, sf_dir):
    """All rewriters, user dictionary and connection costs, over literal Japanese sentences."""
    return morphemes(sentences(spark), make_seed, "sent_id")


def udtf_tokens(spark, sf_dir):
    from ..streaming.tokens import register_udtf

    register_udtf(spark, "tokenize", partial(make_seed, rewrite=()))
    sentences(spark).createOrReplaceTempView("tsumugi_sentences")
    return spark.sql("SELECT sent_id, t.begin, t.end, t.surface, t.pos FROM tsumugi_sentences, LATERAL tokenize(text, 'C') t")


def stream_tokens(spark, sf_dir):
    """The documents as a stream, once through; what it wrote is read back."""
    import os

    from ..sources.files import shared
    from ..streaming.tokens import stream

    out = f"{shared(spark)}/stream-{os.urandom(6).hex()}"
    d = documents(spark, sf_dir)
    rows = stream(spark, f"{sf_dir}/documents.parquet" if os.path.isdir(f"{sf_dir}/documents.parquet") else f"{sf_dir}/document*.parquet", d.schema, latin(spark, sf_dir), "doc_id", columns=TOKENS)
    q = rows.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data")


def queries() -> dict:
    own = [
        line_split, char_category_histogram, normalized_text, category_runs, word_begin_positions, prefix_matches, oov_candidates, tokens_mode_c, morpheme_tsv, pos_frequency, pos_rollup,
        top_terms_by_lang, oov_rate_by_source, toxic_label_terms, span_min_edge, edge_connections, word_info, word_id_lookup, dictionary_print, split_units, user_auto_cost,
        numeric_values, normalized_literals, full_tokens, udtf_tokens, stream_tokens,
    ]
    more = {f"tokens_mode_{m.lower()}": partial(tokens_by_mode, m) for m in "AB"}
    from . import dictionaries, literals

    return {f.__name__: f for f in own} | more | dictionaries.queries() | literals.queries() | {"best_path_literals": best_path, "inhibited_path": lambda s, d: best_path(s, d, _inhibited())}


def oracle_sql() -> dict[str, str]:
    from . import dictionaries, literals

    lex = _LEX_SQL.format(_values(_lexicon_rows()))
    edges = f"e(sent_id, seq, \"begin\", \"end\", left_id, right_id, cost, surface) AS (VALUES {_values(_edges())})"
    token_sql = f"WITH {_tokens()} "
    cat = "CASE " + " ".join(f"WHEN regexp_full_match(run, '{c}+') THEN '{n}'" for n, c in _classes()) + " END"
    unk = _values([(c, cost, ",".join(p)) for c, _, _, cost, p in UNKNOWN if PROPERTIES[c][1]])
    alpha = _JAVA["ALPHA"]
    literal = list(enumerate(["abc", "ガギ", "株式会社", "ⅻ", "ガ", "パピ", "12", "アイス"]))  # written by hand
    return {
        "line_split": f"WITH {_lines()} SELECT doc_id, line_no::INT AS line_no, line FROM lines",
        "char_category_histogram": f"WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), k AS (SELECT ch, count(*) AS n FROM c GROUP BY ch), m AS (SELECT ch, n, coalesce(bit_or(bits), 1)::INT AS mask FROM k LEFT JOIN (VALUES {_values(chars.ranges())}) r(low, high, bits) ON unicode(ch) BETWEEN low AND high GROUP BY ch, n) SELECT mask, sum(n)::BIGINT AS n_chars FROM m GROUP BY mask",
        "normalized_text": "SELECT doc_id, regexp_replace(lower(text), '[-ー⁓〜〰]{2,}', 'ー', 'g') AS normalized FROM documents",
        "category_runs": f"WITH {_runs()} SELECT doc_id, {cat} AS category, count(*) AS n_runs, sum(length(run))::BIGINT AS n_chars, max(length(run))::BIGINT AS longest FROM runs GROUP BY ALL",
        "word_begin_positions": f"WITH {_lines()} SELECT doc_id, sum(len(regexp_extract_all(line, '{alpha}+')) + length(regexp_replace(line, '{alpha}', '', 'g')))::BIGINT AS n_begins FROM lines GROUP BY doc_id",
        "prefix_matches": f"WITH {_tokens()} SELECT l.headword, count(*) AS n_matches FROM tokens t JOIN lex l ON starts_with(t.normalized_form, l.headword) GROUP BY l.headword",
        "oov_candidates": f"WITH {_runs()}, c AS (SELECT {cat} AS category, count(*) AS n FROM runs GROUP BY 1) SELECT category, pos, cost::INT AS cost, n AS n_candidates FROM c JOIN (VALUES {unk}) u(category, cost, pos) USING (category)",
        "tokens_mode_c": token_sql + 'SELECT doc_id, line_no, i, "begin", "end", surface, pos, normalized_form, is_oov FROM tokens',
        "morpheme_tsv": token_sql + "SELECT l.doc_id, l.line_no::INT AS line_no, coalesce(string_agg(surface || chr(9) || pos || chr(9) || normalized_form, chr(10) ORDER BY i) || chr(10), '') || 'EOS' AS text FROM lines l LEFT JOIN tokens t ON l.doc_id = t.doc_id AND l.line_no = t.line_no GROUP BY l.doc_id, l.line_no",
        "pos_frequency": token_sql + "SELECT pos, count(*) AS n FROM tokens GROUP BY pos",
        "pos_rollup": token_sql + "SELECT lang, pos, count(*) AS n FROM tokens JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, pos)",
        "top_terms_by_lang": token_sql + f"SELECT lang, normalized_form, n, rank FROM (SELECT lang, normalized_form, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, normalized_form) AS rank FROM tokens JOIN documents USING (doc_id) WHERE pos = '{dic.NOUN}' GROUP BY lang, normalized_form) WHERE rank <= 10",
        "oov_rate_by_source": token_sql + "SELECT source, count(*) AS n_tokens, count(*) FILTER (is_oov) AS n_oov, count(*) FILTER (is_oov) / count(*) AS oov_rate FROM tokens JOIN documents USING (doc_id) GROUP BY source",
        "toxic_label_terms": token_sql + f"SELECT normalized_form, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tokens WHERE pos = '{dic.NOUN}' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY normalized_form",
        "span_min_edge": f'WITH {edges} SELECT sent_id::BIGINT AS sent_id, "begin"::INT AS "begin", "end"::INT AS "end", cost::INT AS cost, surface FROM e QUALIFY row_number() OVER (PARTITION BY sent_id, "begin", "end" ORDER BY cost, seq) = 1',
        "edge_connections": f'WITH {edges}, m(r, l, c) AS (VALUES {_values([(a, b, c) for (a, b), c in seed().matrix.items()])}) SELECT a.sent_id::BIGINT AS sent_id, count(*) AS n_pairs, sum(coalesce(c, 0))::BIGINT AS sum_cost FROM e a JOIN e b ON a.sent_id = b.sent_id AND a."end" = b."begin" LEFT JOIN m ON a.right_id = r AND b.left_id = l GROUP BY a.sent_id',
        "word_info": f"WITH {lex} SELECT x.dict_id::INT AS dict_id, x.word_id::INT AS word_id, x.surface, coalesce(f.surface, x.surface) AS dictionary_form, x.reading, x.normalized FROM lex x LEFT JOIN lex f ON x.dict_id = f.dict_id AND x.form_id = f.word_id",
        "word_id_lookup": f"WITH {lex} SELECT surface, pos, reading, dict_id::INT AS dict_id, word_id::INT AS word_id FROM lex QUALIFY row_number() OVER (PARTITION BY surface, pos, reading ORDER BY dict_id = 0, dict_id, word_id) = 1",
        "dictionary_print": f"WITH {lex}, u AS (SELECT *, CASE WHEN a = '' THEN 'A' WHEN b = '' THEN 'B' ELSE 'C' END AS unit FROM lex) SELECT dict_id::INT AS dict_id, word_id::INT AS word_id, concat_ws(',', surface, left_id, cost, pos, reading, normalized, unit, CASE WHEN a = '' THEN '*' ELSE a END) AS line, unit FROM u",
        "split_units": f"WITH {lex}, p AS (SELECT dict_id, word_id, headword, unnest(string_split(a, '/')) AS ref, generate_subscripts(string_split(a, '/'), 1) - 1 AS k FROM lex WHERE a <> '') SELECT p.dict_id::INT AS dict_id, p.word_id::INT AS word_id, p.headword, k::BIGINT AS k, u.headword AS unit, (coalesce(sum(length(u.headword)) OVER (PARTITION BY p.dict_id, p.word_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"begin\" FROM p JOIN lex u ON p.ref = u.dict_id || ':' || u.word_id",
        "numeric_values": f"SELECT numeral, CASE WHEN NOT regexp_full_match(numeral, '[0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+') OR regexp_full_match(numeral, '0+,.*') THEN NULL ELSE replace(numeral, ',', '') END AS value FROM (VALUES {_values([(x,) for x in NUMERALS])}) v(numeral)",
        "normalized_literals": f"SELECT id::INT AS id, normalized FROM (VALUES {_values(literal)}) v(id, normalized)",
        "tokens_mode_a": _mode_sql("A"),
        "tokens_mode_b": _mode_sql("B"),
        "udtf_tokens": f'SELECT sent_id, "begin", "end", surface, pos FROM ({_mode_sql("C")})',
        "user_auto_cost": _auto_cost_sql(),
        "stream_tokens": token_sql + 'SELECT doc_id, line_no, i, "begin", "end", surface, pos, normalized_form, is_oov FROM tokens',
        "best_path_literals": _best_sql(),
        "inhibited_path": _best_sql(_inhibited()),
    } | dictionaries.oracle_sql() | literals.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_mode_c(spark, sf_dir)
