"""The tokenizer: lattice, least-cost path, path rewriting, splitting. One line is one unit of work; a Spark job runs it
over Arrow batches, a tokenizer per worker, so that no shuffle is needed.

A lattice edge is (begin, end, left, right, cost, word id or None, part of speech); edges are inserted in order of their
place: user dictionaries, then the system's, shorter words first, then proposals for unknown words. Of paths of equal
cost the one with the edge inserted first is taken.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions import chars as ch
from ..functions.normalize import KEEP, MARKS, Normalizer, squeeze
from ..functions.numeric import Parser
from ..sources.definitions import PROPERTIES, UNKNOWN
from .dictionary import Dictionary

INHIBITED = 32767
NUMBER = ("名詞", "数詞", "*", "*", "*", "*")
LETTERS = ch.BIT["ALPHA"] | ch.BIT["GREEK"] | ch.BIT["CYRILLIC"]  # see chars.can_begin
NEWLINE = re.compile(r"\r\n|\r|\n")


class Node(NamedTuple):
    begin: int
    end: int
    left: int
    right: int
    cost: int
    wid: tuple[int, int] | None
    pos: tuple[str, ...]
    surface: str
    normalized: str
    form: str
    reading: str
    oov: bool


class NoMorpheme(ValueError):
    pass


class Tokenizer:
    def __init__(self, dictionary: Dictionary, *, marks=MARKS, mark_to: str = "ー", normalize: bool = True, oov=("mecab", "simple"), simple=(("補助記号", "一般", "*", "*", "*", "*"), 5968, 5968, 3857), unknown=None, properties=None, table=None, rewrite=("numeric", "katakana"), normalize_numeric: bool = True, katakana_pos=("名詞", "普通名詞", "一般", "*", "*", "*"), min_length: int = 3, compat: str = "reference", texts=(), replace=None, keep=None):
        """Besides names, `oov` takes callables (text, place, mask, end of the run, whether words begin here) -> nodes and
        `rewrite` callables (path, masks, run ends, edges) -> path; `texts` are callables (characters, places) -> the
        same, after normalisation and marks. `replace` and `keep` are the normaliser's rules."""
        if not oov:
            raise ValueError("at least one provider of unknown words")
        for what, names, known in (("provider of unknown words", oov, ("mecab", "simple")), ("path rewriter", rewrite, ("numeric", "katakana"))):
            for n in names:
                if n not in known and not callable(n):
                    raise ValueError(f"{what}: {n} is unknown")
        self.texts = tuple(texts)
        self.dic, self.norm = dictionary, Normalizer(replace, KEEP if keep is None else keep) if normalize else None
        self.marks, self.mark_to = marks, mark_to
        self.cats = ch.Categories(table)
        self.oov, self.simple = oov, simple
        props, rows = properties or PROPERTIES, unknown or UNKNOWN
        self.unk = [(ch.BIT[c], *props[c], [(le, r, co, p) for cat, le, r, co, p in rows if cat == c]) for c in ch.NAMES if c in props and any(u[0] == c for u in rows)]
        self.rewrite, self.normalize_numeric, self.compat = rewrite, normalize_numeric, compat
        self.katakana_pos, self.min_length = katakana_pos, min_length
        # where no word reaches across runs, nothing connects at a cost, and a line's characters have one category each,
        # runs are independent of each other and their paths can be remembered
        self.by_run = not self.dic.matrix and not self.texts and all(map(lambda o: isinstance(o, str), oov)) and all(len(set(self.cats.masks(h))) == 1 for h in self.dic.lookup)
        if self.by_run:  # of unknown words over one span only the cheapest, the first of equal ones, can be on a path
            self.unk = [(*u[:4], [min(u[4], key=lambda r: r[2])]) for u in self.unk]
        self.cache: dict[str, list[Node]] = {}
        classes = self.cats.classes()
        self.runs = re.compile("|".join(f"[{_py(c)}]+" for c in classes.values()))

    # --- text
    def text(self, line: str) -> tuple[str, list[int]]:
        chars, places = self.norm(line) if self.norm else (list(line), list(range(len(line) + 1)))
        if self.marks:
            chars, places = squeeze(chars, places, self.marks, self.mark_to)
        for f in self.texts:
            chars, places = f(chars, places)
        return "".join(chars), places

    # --- lattice
    def _unknown(self, text: str, at: int, mask: int, run_end: int, has: bool) -> list[Node]:
        out = []
        for bit, invoke, group, length, rows in self.unk:
            if not mask & bit or not (invoke or not has):
                continue
            ends = [run_end] if group else []
            last = run_end - 1 if group else run_end  # a grouped run isn't proposed twice
            ends += [at + k for k in range(1, length + 1) if at + k <= last]
            for e in ends:
                s = text[at:e]
                out += [Node(at, e, le, r, c, None, p, s, s, s, "", True) for le, r, c, p in rows]
        return out

    def _propose(self, kind, text: str, at: int, mask: int, run_end: int, has: bool) -> list[Node]:
        if callable(kind):
            return kind(text, at, mask, run_end, has)
        if kind == "mecab":
            return self._unknown(text, at, mask, run_end, has)
        if has:
            return []
        p, le, r, c = self.simple
        return [Node(at, at + 1, le, r, c, None, p, text[at], text[at], text[at], "", True)]

    def proposed(self, mask: int, n: int) -> str | None:
        """Part of speech of the unknown word over a whole run of n letters of one category; None if there is none, or if
        it depends on whether a word begins the run. Letters begin a word only at the run's first character, so that no
        other proposal can be on a path."""
        found = set()
        for has in (False, True):
            own: list[Node] = []
            for kind in self.oov:
                own += self._propose(kind, "a" * n, 0, mask, n, has or bool(own))
            if not own and not has:
                own = self._propose(self.oov[0], "a" * n, 0, mask, n, False)
            best = min((e for e in own if e.end == n), key=lambda e: e.cost, default=None)
            found.add(best and ",".join(best.pos))
        return found.pop() if len(found) == 1 else None

    def lattice(self, text: str) -> tuple[list[int], list[int], list[Node]]:
        masks = self.cats.masks(text)
        ends, starts = ch.run_ends(masks), ch.can_begin(masks)
        reached, edges = {0}, []
        for at in range(len(text)):
            if not starts[at] or at not in reached:
                continue
            own = []
            for wid, end in self.dic.prefixes(text, at):
                w = self.dic.word(wid)
                own.append(Node(at, end, w.left, w.right, w.cost, wid, w.pos, w.surface, w.normalized, w.dictionary_form, w.reading, False))
            if not masks[at] & ch.BIT["NOOOVBOW"]:
                for kind in self.oov:
                    own += self._propose(kind, text, at, masks[at], ends[at], bool(own))
            if not own:
                own = self._propose(self.oov[0], text, at, masks[at], ends[at], False)
            if not own:
                raise NoMorpheme(f"there is no morpheme at {at}")
            edges += own
            reached.update(n.end for n in own)
        return masks, ends, edges

    def best(self, n: int, edges: list[Node]) -> list[Node]:
        """Least total of edge and connection costs; inhibited connections don't exist."""
        matrix = self.dic.matrix
        ending: dict[int, list[tuple[int, int, int]]] = {0: [(0, 0, -1)]}  # end: (total, right id, edge)
        back: list[int] = []
        for k, e in enumerate([*edges, Node(n, n, 0, 0, 0, None, (), "", "", "", "", False)]):
            low, prev = None, -1
            for total, right, j in ending.get(e.begin, ()):
                c = matrix.get((right, e.left), 0) if matrix else 0
                if c != INHIBITED and (low is None or total + c < low):
                    low, prev = total + c, j
            back.append(prev)
            if low is not None and k < len(edges):
                ending.setdefault(e.end, []).append((low + e.cost, e.right, k))
        if low is None:
            raise NoMorpheme("the end isn't reached")
        path, k = [], back[-1]
        while k >= 0:
            path.append(edges[k])
            k = back[k]
        return path[::-1]

    # --- rewriting
    def _join(self, nodes: list[Node], normalized: str | None) -> Node:
        cat = lambda name: "".join(getattr(x, name) for x in nodes)
        return Node(nodes[0].begin, nodes[-1].end, 0, 0, 0, None, nodes[0].pos, cat("surface"), cat("normalized") if normalized is None else normalized, cat("form"), cat("reading"), False)

    def join_numeric(self, path: list[Node], masks, ends) -> list[Node]:
        path, start, signs, parser = list(path), -1, {",": True, ".": True}, Parser(self.compat)
        digit = ch.BIT["NUMERIC"] | ch.BIT["KANJINUMERIC"]

        def join(a: int, b: int):
            if path[a].pos != NUMBER:
                return
            value = parser.value() if self.normalize_numeric else None
            if b - a > 1 or (value is not None and value != path[a].normalized):
                path[a:b] = [self._join(path[a:b], value)]

        def finish(i: int) -> int | None:
            """Join what was read up to i; the index from which to go on."""
            if parser.done():
                join(start, i)
                return start + 2
            tail = path[i - 1].normalized
            if (parser.error, tail) in (("comma", ","), ("point", ".")):
                join(start, i - 1)
                return start + 3
            return None

        i = 0
        while i < len(path):
            s = path[i].normalized
            step = i + 1
            if ch.span_mask(masks, ends, path[i].begin, path[i].end) & digit or signs.get(s, False):
                if start < 0:
                    parser.clear()
                    start = i
                for c in s:
                    if not parser.append(c):
                        sign = {"comma": ",", "point": "."}.get(parser.error)
                        if sign:
                            signs[sign] = False
                            step = start
                        start = -1
                        break
            else:
                if start >= 0:
                    step = finish(i) or step
                start = -1
                for sign in signs:
                    if s != sign:
                        signs[sign] = True
            i = step
        if start >= 0:
            finish(len(path))
        return path

    def join_katakana(self, path: list[Node], masks, ends, edges: list[Node]) -> list[Node]:
        path = list(path)
        kana = lambda n: ch.span_mask(masks, ends, n.begin, n.end) & ch.BIT["KATAKANA"]
        i = 0
        while i < len(path):
            n = path[i]
            if (n.oov or n.end - n.begin < self.min_length) and kana(n):
                a, b = i, i + 1
                while a > 0 and kana(path[a - 1]):
                    a -= 1
                while b < len(path) and kana(path[b]):
                    b += 1
                while a != b and ch.span_mask(masks, ends, path[a].begin, path[a].end) & ch.BIT["NOOOVBOW"]:
                    a += 1
                if b - a > 1:
                    begin, end = path[a].begin, path[b - 1].end
                    same = [e for e in edges if (e.begin, e.end) == (begin, end)]
                    s = "".join(x.surface for x in path[a:b])
                    path[a:b] = [min(same, key=lambda e: e.cost) if same else Node(begin, end, 0, 0, 0, None, tuple(self.katakana_pos), s, s, s, "", True)]
                    i = a + 1
            i += 1
        return path

    # --- splitting
    def split(self, node: Node, mode: str) -> list[Node]:
        if mode not in "ABC" or len(mode) != 1:
            raise ValueError(f"mode {mode}")
        units = [] if mode == "C" or node.wid is None else getattr(self.dic.word(node.wid), mode.lower())
        if len(units) < 2:
            return [node]
        out, at = [], node.begin
        for wid in units:
            w = self.dic.word(wid)
            out.append(Node(at, at + len(w.headword), 0, 0, 0, wid, w.pos, w.surface, w.normalized, w.dictionary_form, w.reading, False))
            at += len(w.headword)
        return out

    # --- all of it
    def _placed(self, text: str, mode: str) -> list[tuple[int, Node]]:
        """(place to add, node) of each morpheme of a normalised text."""
        if not text:
            return []
        if self.by_run and not self.rewrite and mode == "C":
            runs = self.runs.findall(text)
            if sum(map(len, runs)) == len(text):
                out, at, cache = [], 0, self.cache
                for r in runs:
                    got = cache.get(r)
                    if got is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        got = cache[r] = self.best(len(r), self.lattice(r)[2])
                    for n in got:
                        out.append((at, n))
                    at += len(r)
                return out
        masks, ends, edges = self.lattice(text)
        path = self.rewritten(self.best(len(text), edges), masks, ends, edges)
        return [(0, u) for n in path for u in self.split(n, mode)]

    def rewritten(self, path: list[Node], masks, ends, edges: list[Node]) -> list[Node]:
        for r in self.rewrite:
            path = r(path, masks, ends, edges) if callable(r) else self.join_numeric(path, masks, ends) if r == "numeric" else self.join_katakana(path, masks, ends, edges)
        return path

    def dump(self, line: str) -> list[tuple[str, int, int, str, int]]:
        """What analysis goes through, as (stage, begin, end, surface, cost): the normalised text, every edge of the
        lattice, the path before rewriting and after."""
        text, _ = self.text(line)
        masks, ends, edges = self.lattice(text)
        path = self.best(len(text), edges)
        stages = (("lattice", edges), ("before rewriting", path), ("after rewriting", self.rewritten(path, masks, ends, edges)))
        return [("text", 0, len(text), text, 0), *[(name, n.begin, n.end, n.surface, n.cost) for name, nodes in stages for n in nodes]]

    def nodes(self, text: str, mode: str = "C") -> list[Node]:
        """Morphemes of a normalised text, in its places."""
        return [n._replace(begin=n.begin + k, end=n.end + k) if k else n for k, n in self._placed(text, mode)]

    def tokenize(self, line: str, mode: str = "C") -> list[tuple]:
        """(begin, end, surface, pos, normalised, dictionary form, reading, is_oov, dictionary id, word id), places and
        surfaces in the original text."""
        if mode not in ("A", "B", "C"):
            raise ValueError(f"mode {mode}")
        text, at = self.text(line)
        return [
            (b := at[k + n.begin], e := at[k + n.end], line[b:e], n.pos, n.normalized, n.form, n.reading, n.oov, -1 if n.wid is None else n.wid[0], -1 if n.wid is None else n.wid[1])
            for k, n in self._placed(text, mode)
        ]


def _py(body: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", body)


def auto_cost(dictionary: Dictionary, headword: str, **how) -> int:
    """Cost of a user word: that of its last morpheme less that of its first, less 20 per morpheme, in 16 bits."""
    nodes = Tokenizer(dictionary, rewrite=(), **how).nodes(headword)
    cost = (nodes[-1].cost - nodes[0].cost if nodes else 0) - 20 * len(nodes)
    return max(-32768, min(32767, cost))
