"""Morphemes of a text column: one narrow map over Arrow batches, no shuffle; a tokenizer is built once per worker.

Where runs of one category are independent of each other (`Tokenizer.by_run`), a text of plain characters is cut into
runs by one pattern, a distinct run is analysed once as long as it is remembered, and columns are gathered from the
runs' finished morphemes by index. All other texts go through the lattice line by line. What a worker holds is bounded:
so many runs, and texts of so many bytes at a time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokenize import LETTERS, NEWLINE, NoMorpheme, Tokenizer

_BUILT: dict = {}
FIELDS = [
    ("line_no", "int"), ("i", "int"), ("begin", "int"), ("end", "int"), ("surface", "string"), ("pos", "string"), ("normalized_form", "string"),
    ("dictionary_form", "string"), ("reading_form", "string"), ("is_oov", "boolean"), ("dictionary_id", "int"), ("word_id", "int"), ("error", "string"),
]
TEXTS, BYTES = 256, 1 << 19  # bound what is held for one output batch; a longer text is one by itself
RUNS = 100_000  # distinct ones that a worker remembers
MAKERS = 4  # whose tokenizers a worker keeps


def lines_of(text: str) -> list[str]:
    """CR, LF and CRLF end a line; what follows the last end is a line only if it isn't empty."""
    out = NEWLINE.split(text)
    return out[:-1] if out and not out[-1] else out


class Runs:
    """The morphemes of runs, once per distinct run among `most` at a time. Number 0 is a line's end. A run of letters that
    isn't a word has one morpheme, the unknown word that is proposed for its category and length; no lattice is made."""

    def __init__(self, t: Tokenizer, most: int = RUNS):
        self.t, self.most, self.wanted = t, most, ()
        by_mask: dict[int, list[str]] = {}
        odd = set("".join([*(t.norm.replace if t.norm else ()), *t.marks]))
        self.to: dict[int, str] = {}  # what plain letters are normalised to
        self.letters: dict[str, int] = {}  # their masks
        self.proposed: dict[tuple[int, int], str | None] = {}
        self.longest = 2 + max([0, *(u[3] for u in t.unk)])  # from this length on, proposals are alike
        for c in map(chr, range(0x250)):
            text, places = t.text(c)
            m = t.cats.mask(c)
            if c not in "\r\n" and len(text) == 1 and places == [0, 1] and t.cats.mask(text) == m and m & (m - 1) == 0 and not odd & {c, text}:
                by_mask.setdefault(m, []).append(re.escape(c))
                if m & LETTERS:
                    self.to[ord(c)], self.letters[c] = text, m
        self.plain = re.compile("[" + "".join(chain.from_iterable(by_mask.values())) + "\r\n]*").fullmatch
        self.cut = re.compile("\r\n|[\r\n]|" + "|".join("[" + "".join(cs) + "]+" for cs in by_mask.values())).findall
        self.clear()

    def clear(self) -> None:
        self.number = {"\n": 0, "\r": 0, "\r\n": 0}
        self.ends, self.length = array("q", [0, 0]), array("q", [0])  # of runs: morphemes up to each, characters
        self.rows: list[tuple] = []  # not yet in the columns
        self.columns: dict = {}  # those of self.wanted

    def analysed(self, run: str) -> list[tuple]:
        mask = self.letters.get(run[:1])
        if mask:
            text, n = run.translate(self.to), len(run)
            if text not in self.t.dic.lookup:
                key = (mask, min(n, self.longest))
                if key not in self.proposed:
                    self.proposed[key] = self.t.proposed(*key)
                pos = self.proposed[key]
                if pos is not None:
                    return [(0, n, run, pos, text, text, "", True, -1, -1)]
        text, _ = self.t.text(run)
        return [
            (n.begin, n.end, run[n.begin : n.end], ",".join(n.pos), n.normalized, n.form, n.reading, n.oov, -1 if n.wid is None else n.wid[0], -1 if n.wid is None else n.wid[1])
            for n in self.t.best(len(text), self.t.lattice(text)[2])
        ]

    def numbers(self, text: str) -> list[int]:
        """Numbers of the text's runs; NoMorpheme if one of them can't be cut."""
        runs = self.cut(text)
        found = list(map(self.number.get, runs))
        if None in found:
            for r in {r for r, k in zip(runs, found) if k is None}:
                rows = self.analysed(r)
                self.number[r] = len(self.length)
                self.rows += rows
                self.ends.append(self.ends[-1] + len(rows))
                self.length.append(len(r))
            found = list(map(self.number.__getitem__, runs))
        return found

    def gather(self, lists: list[list[int]], wanted: Sequence[str], kinds: dict):
        """(which text each morpheme is of, the wanted columns) of texts given as numbers of runs."""
        import pyarrow as pa

        stored = [(k, n, kinds[t]) for k, (n, t) in enumerate(FIELDS[2:12]) if n in self.wanted]
        if not self.columns:
            self.columns = {n: pa.array([], t) for _, n, t in stored}
        if self.rows:
            for k, n, t in stored:
                self.columns[n] = pa.concat_arrays([self.columns[n], pa.array([r[k] for r in self.rows], t)])
            self.rows = []
        sizes = np.array(list(map(len, lists)), np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
        ends = np.array(self.ends, np.int64)
        n = ends[flat + 1] - ends[flat]
        before = np.cumsum(n) - n
        run = np.repeat(np.arange(len(flat)), n)
        node = (ends[flat] - before)[run] + np.arange(len(run))
        text = np.repeat(np.arange(len(lists)), sizes)
        over = flat == 0
        begins = np.ones(len(flat), bool)  # does a line begin with this run?
        begins[1:] = over[:-1] | (text[1:] != text[:-1])
        since = lambda x: x - np.maximum.accumulate(np.where(begins, x, 0)) if len(x) else x
        own, out = {}, []
        if "line_no" in wanted:
            up = np.cumsum(over) - over
            first = np.zeros(len(lists), np.int64)
            heads = np.cumsum(sizes) - sizes
            first[sizes > 0] = up[heads[sizes > 0]]
            own["line_no"] = (up - first[text])[run]
        if "i" in wanted:
            own["i"] = np.arange(len(run)) - (before - since(before))[run]
        if "begin" in wanted or "end" in wanted:
            length = np.array(self.length, np.int64)[flat]
            at = since(np.cumsum(length) - length)[run]
            for name in {"begin", "end"} & {*wanted}:
                own[name] = at + self.columns[name].to_numpy()[node]
        take = pa.array(node)
        for name, kind in [f for f in FIELDS if f[0] in wanted]:
            if name in own:
                out.append(pa.array(own[name], kinds[kind]))
            elif name == "error":
                out.append(pa.nulls(len(run), pa.string()))
            else:
                out.append(self.columns[name].take(take))
        return text[run], out


def _built(make, wanted: Sequence[str] = ()) -> tuple[Tokenizer, Runs | None]:
    """A maker's tokenizer and its runs, which keep the wanted columns only."""
    if make not in _BUILT:
        while len(_BUILT) >= MAKERS:
            del _BUILT[next(iter(_BUILT))]
        t = make()
        _BUILT[make] = (t, Runs(t) if t.by_run and not t.rewrite else None)
    t, runs = _BUILT[make]
    if runs and runs.wanted != tuple(wanted):
        runs.wanted = tuple(wanted)
        runs.clear()
    return t, runs


def parts(batch, column: int):
    """A batch in slices of TEXTS rows at most, and of BYTES of texts unless one alone has more."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        fit = int(np.searchsorted(ends, ends[lo] - sizes[lo] + BYTES, "right"))
        hi = min(lo + TEXTS, max(fit, lo + 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def morphemes(df: DataFrame, make: Callable[[], Tokenizer], key: str, text: str = "text", mode: str = "C", strict: bool = False, columns: list[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns `keep` of df, then `columns` of FIELDS (all by default), a row per morpheme of each line. A line
    that can't be cut raises if strict; else it gives one row with its error. Null texts give no rows. `make` is called
    once per worker; columns that aren't asked for aren't built."""
    import pyarrow as pa

    if mode not in ("A", "B", "C"):
        raise ValueError(f"mode {mode}")
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    wanted = [f for f in FIELDS if columns is None or f[0] in columns]
    pick = [[n for n, _ in FIELDS].index(n) for n, _ in wanted]
    schema = T.StructType([*[df.schema[c] for c in (key, *keep)], *[T.StructField(n, {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}[t]) for n, t in wanted]])
    names = [f.name for f in schema.fields]

    def by_line(t, texts):
        """Rows and, for each text, how many."""
        joined: dict = {}
        rows, counts = [], []
        for x in texts:
            before = len(rows)
            for no, line in enumerate(lines_of(x or "")):
                try:
                    for i, m in enumerate(t.tokenize(line, mode)):
                        p = joined.get(m[3])
                        if p is None:
                            p = joined[m[3]] = ",".join(m[3])
                        rows.append((no, i, m[0], m[1], m[2], p, m[4], m[5], m[6], m[7], m[8], m[9], None))
                except NoMorpheme as e:
                    if strict:
                        raise
                    rows.append((no, None, None, None, None, None, None, None, None, None, None, None, str(e)))
            counts.append(len(rows) - before)
        return rows, counts

    def run(batches):
        names_wanted = [n for n, _ in wanted]
        t, runs = _built(make, names_wanted)
        for b in batches:
            for part in parts(b, b.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                plain, lists, rest = [], [], []
                for k, x in enumerate(texts):
                    if runs and mode == "C" and x and runs.plain(x):
                        try:
                            lists.append(runs.numbers(x))
                            plain.append(k)
                            continue
                        except NoMorpheme:
                            pass
                    rest.append(k)
                if plain:
                    of, cols = runs.gather(lists, names_wanted, kinds)
                    take = pa.array(np.array(plain, np.int64)[of])
                    yield pa.RecordBatch.from_arrays([*[part.column(i).take(take) for i in range(part.num_columns - 1)], *cols], names=names)
                    if len(runs.number) > runs.most:
                        runs.clear()
                rows, counts = by_line(t, [texts[k] for k in rest])
                if rows:
                    cols = list(zip(*rows))
                    take = pa.array(np.repeat(np.array(rest, np.int64), counts))
                    yield pa.RecordBatch.from_arrays([*[part.column(i).take(take) for i in range(part.num_columns - 1)], *[pa.array(cols[j], kinds[t_]) for j, (_, t_) in zip(pick, wanted)]], names=names)

    return spread(df.select(key, *keep, text)).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks can run at once: a small table's only row group is one task otherwise.
    Input with more partitions, as any large one has, isn't shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if not df.isStreaming and df.rdd.getNumPartitions() < n else df


def tsv(df: DataFrame, make: Callable[[], Tokenizer], key: str, text: str = "text", mode: str = "C", full: bool = False, strict: bool = True) -> DataFrame:
    """key, line_no, text: surface, part of speech and normalised form by tabs, one morpheme a line, then EOS; with
    `full` also dictionary form, reading, dictionary id, and (OOV) for unknown words. Every line has its row, an empty
    one with EOS alone. A line that can't be cut raises if strict, else it is left out. Lines are whole in the map, so
    nothing is shuffled."""
    import pyarrow as pa

    schema = T.StructType([df.schema[key], T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType())])

    def row(m) -> str:
        parts = [m[2], m[3] if isinstance(m[3], str) else ",".join(m[3]), m[4]]
        if full:
            parts += [m[5], m[6], str(m[8]), *["(OOV)"] * bool(m[7])]
        return "\t".join(parts)

    def run(batches):
        t, runs = _built(make)
        known: dict[str, str] = {}

        def lookup(r: str) -> str:
            got = known.get(r)
            if got is None:
                got = known[r] = "\n".join(map(row, runs.analysed(r)))
            return got

        for b in batches:
            for part in parts(b, 1):
                of, no, out = [], [], []
                for k, x in enumerate(part.column(1).to_pylist()):
                    plain = runs and mode == "C" and x and runs.plain(x)
                    for i, line in enumerate(lines_of(x or "")):
                        try:
                            said = list(map(lookup, runs.cut(line))) if plain else list(map(row, t.tokenize(line, mode)))
                        except NoMorpheme:
                            if strict:
                                raise
                            continue
                        of.append(k)
                        no.append(i)
                        out.append("\n".join([*said, "EOS"]))
                if len(known) > RUNS:
                    known.clear()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=[key, "line_no", "text"])

    return spread(df.select(key, text)).mapInArrow(run, schema)
