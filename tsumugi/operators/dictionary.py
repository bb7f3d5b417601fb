"""Dictionaries: lexicon rows, validation, parts of speech, split references, layers of user dictionaries, printing."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

COLUMNS = 18
MAX_STRING, MAX_SPLITS = 32767, 127
ESCAPE = re.compile(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))")


def unescape(s: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), s)


@dataclass
class Word:
    headword: str
    left: int
    right: int
    cost: int
    surface: str
    pos: tuple[str, ...]
    reading: str
    normalized: str
    form_id: int = -1
    unit: str = "*"
    a: list = field(default_factory=list)
    b: list = field(default_factory=list)
    structure: list = field(default_factory=list)
    dictionary_form: str = ""


def _refs(cell: str) -> list:
    """Split references before they are resolved: numbers, U numbers, or (surface, p0..p5, reading)."""
    if cell in ("*", ""):
        return []
    out: list = []
    for part in cell.split("/"):
        if re.fullmatch(r"\d+", part):
            out.append(int(part))
        elif re.fullmatch(r"U\d+", part):
            out.append(("U", int(part[1:])))
        else:
            p = unescape(part).split(",")
            if len(p) != 8:
                raise ValueError(f"split reference {part}")
            out.append((p[0], tuple(p[1:7]), p[7]))
    return out


def parse_row(line: str) -> Word:
    """One row of 18 columns, without quoting; \\uXXXX and \\u{...} are decoded in every column."""
    raw = line.rstrip("\r\n").split(",")
    if len(raw) != COLUMNS:
        raise ValueError(f"{len(raw)} columns: {line}")
    p = [x if i in (15, 16, 17) else unescape(x) for i, x in enumerate(raw)]
    if any(len(p[i]) > MAX_STRING for i in (0, 4, 11, 12)):
        raise ValueError("string too long")
    if not p[0]:
        raise ValueError("empty headword")
    left, right, cost = (int(x) for x in p[1:4])
    if not all(-32768 <= x <= 32767 for x in (left, right, cost)):
        raise ValueError(f"not 16 bits: {line}")
    a, b, s = (_refs(x) for x in p[15:18])
    if max(map(len, (a, b, s))) > MAX_SPLITS:
        raise ValueError("too many units")
    if p[14] == "A" and (a or b):
        raise ValueError("a unit of type A has no splits")
    return Word(p[0], left, right, cost, p[4], tuple(p[5:11]), p[11] or p[4], p[12] or p[4], -1 if p[13] == "*" else int(p[13]), p[14], a, b, s)


class Dictionary:
    """System words (dictionary 0) and user dictionaries 1, 2, ...; word ids are (dictionary, number)."""

    def __init__(self, rows: list[str] | None, matrix: dict[tuple[int, int], int] | None = None):
        self.layers: list[list[Word]] = []
        #: all parts of speech by id: the system's as first seen, then those that each user dictionary adds of its own
        self.pos_list: list[tuple[str, ...]] = []
        self.pos_of: list[dict[tuple[str, ...], int]] = []  # by layer: ids of the parts of speech it brings
        self.pos_first: list[int] = []
        self.matrix = dict(matrix or {})
        self.lookup: dict[str, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        if rows is not None:
            self.add(rows)

    def add(self, rows: list[str], cost_of=None) -> None:
        """Add a layer. Costs of -32768 are computed by cost_of(dictionary so far, headword)."""
        words = [parse_row(r) for r in rows if r.strip()]
        d = len(self.layers)
        self.add_words(words, cost_of, resolve=lambda r: self._resolve(d, r))

    def add_words(self, words: list[Word], cost_of=None, pos: list[tuple[str, ...]] | None = None, resolve=None) -> None:
        """Add a layer of words; `pos` are the parts of speech that it brings, by default those of its words that the
        system lacks, as first seen. A user's own are numbered behind all before, also where another user has the same."""
        if len(self.layers) == 16:
            raise ValueError("16 dictionaries at most")
        d = len(self.layers)
        if cost_of:
            for w in words:
                if w.cost == -32768:
                    w.cost = cost_of(self, w.headword)
        system = self.pos_of[0] if d else {}
        own = list(dict.fromkeys(w.pos for w in words if w.pos not in system)) if pos is None else list(pos)
        self.pos_first.append(len(self.pos_list))
        self.pos_of.append({p: len(self.pos_list) + k for k, p in enumerate(own)})
        self.pos_list += own
        self.layers.append(words)
        for i, w in enumerate(words):
            if resolve:
                for name in ("a", "b", "structure"):
                    setattr(w, name, [resolve(r) for r in getattr(w, name)])
            w.dictionary_form = words[w.form_id].surface if w.form_id >= 0 else w.surface
            if w.left != -1:  # others are found as units of a split only
                self.lookup.setdefault(w.headword, []).append((d, i))
        order = lambda x: (x[0] == 0, x)  # user dictionaries come before the system's
        for ids in self.lookup.values():
            ids.sort(key=order)
        self.lengths = sorted({len(h) for h in self.lookup})

    def pos_id(self, pos: tuple[str, ...], layer: int = 0) -> int:
        """Id of a part of speech as words of a layer have it: the system's, else the layer's own; -1 if unknown."""
        return self.pos_of[0].get(pos, self.pos_of[layer].get(pos, -1))

    def _resolve(self, d: int, ref) -> tuple[int, int]:
        if isinstance(ref, int):
            found = (0, ref)
        elif ref[0] == "U" and len(ref) == 2:
            found = (d, ref[1])
        else:
            got = self.word_id(*ref, first=d)
            if got is None:
                raise ValueError(f"no such word: {ref}")
            found = got
        if not 0 <= found[1] < len(self.layers[found[0]]):
            raise ValueError(f"no such word: {ref}")
        return found

    def word_id(self, surface: str, pos: tuple[str, ...], reading: str, first: int = 0):
        """First word with this surface, part of speech and reading: in layer `first`, then in the system's."""
        for d in dict.fromkeys((first, 0)):
            for i, w in enumerate(self.layers[d]):
                if (w.surface, w.pos, w.reading) == (surface, pos, reading):
                    return d, i
        return None

    def word(self, wid: tuple[int, int]) -> Word:
        return self.layers[wid[0]][wid[1]]

    def prefixes(self, text: str, at: int):
        """(word id, end) of all words that begin at a place: user dictionaries first, then by length."""
        found = []
        for k in self.lengths:
            if at + k > len(text):
                break
            for wid in self.lookup.get(text[at : at + k], ()):
                found.append((wid[0] == 0, wid[0], k, wid[1], wid))
        return [(wid, at + k) for _, _, k, _, wid in sorted(found)]

    def inhibit(self, left: int, right: int) -> None:
        self.matrix[left, right] = 32767

    def printed(self, layer: int = 0) -> list[str]:
        """One line per word: surface, ids, cost, surface, part of speech, reading, normalised form, form id, unit type,
        splits and structure."""
        ids = lambda refs: "/".join(("U" if d else "") + str(i) for d, i in refs) or "*"
        out = []
        for w in self.layers[layer]:
            unit = "A" if not w.a else "B" if not w.b else "C"
            out.append(",".join(map(str, [w.surface, w.left, w.right, w.cost, w.surface, *w.pos, w.reading, w.normalized, w.form_id if w.form_id >= 0 else "*", unit, ids(w.a), ids(w.b), ids(w.structure)])))
        return out


def _row(head, left, cost, pos, reading, norm=None, form="*", unit="A", a="*", b="*"):
    return f"{head},{left},{left},{cost},{head},{pos},{reading},{norm or head},{form},{unit},{a},{b},*"


NOUN, NUM, PLACE, SUFFIX = "名詞,普通名詞,一般,*,*,*", "名詞,数詞,*,*,*,*", "名詞,固有名詞,地名,一般,*,*", "接尾辞,名詞的,一般,*,*,*"
SYSTEM = [
    _row("東京", 4791, 5000, PLACE, "トウキョウ"),
    _row("都", 5140, 3000, SUFFIX, "ト"),
    _row("東京都", 4791, 5300, PLACE, "トウキョウト", unit="C", a="0/1", b="0/1"),
    _row("へ", 100, 1000, "助詞,格助詞,*,*,*,*", "エ"),
    _row("行く", 600, 5105, "動詞,非自立可能,*,*,五段-カ行,終止形-一般", "イク"),
    _row("行っ", 601, 5122, "動詞,非自立可能,*,*,五段-カ行,連用形-促音便", "イッ", "行く", "4"),
    _row("た", 200, 1200, "助動詞,*,*,*,助動詞-タ,終止形-一般", "タ"),
    _row("電気", 5139, 4000, NOUN, "デンキ"),
    _row("通信", 5139, 4200, NOUN, "ツウシン"),
    _row("大学", 5139, 3900, NOUN, "ダイガク"),
    _row("大学院", 5139, 4300, NOUN, "ダイガクイン"),
    _row("電気通信", 5139, 7000, NOUN, "デンキツウシン", unit="B", a="7/8"),
    _row("電気通信大学", 4785, 9000, "名詞,固有名詞,一般,*,*,*", "デンキツウシンダイガク", unit="C", a="7/8/9", b="11/9"),
    *[_row(c, 4794, 2500, NUM, r) for c, r in zip("〇一二三四五六七八九十百千万億兆", "ゼロ イチ ニ サン ヨン ゴ ロク ナナ ハチ キュウ ジュウ ヒャク セン マン オク チョウ".split())],
    *[_row(c, 4794, 2400, NUM, c) for c in "0123456789"],
    _row(".", 5968, 2000, "補助記号,句点,*,*,*,*", "."),
    _row("・", 5968, 2000, "補助記号,一般,*,*,*,*", "・"),
    _row("。", 5968, 1800, "補助記号,句点,*,*,*,*", "。"),
    _row("アイス", 5139, 5000, NOUN, "アイス"),
    _row("の", 100, 900, "助詞,格助詞,*,*,*,*", "ノ"),
    _row("\\u002c", 5968, 2000, "補助記号,読点,*,*,*,*", "\\u002c", "\\u002c").replace("\\u002c,5968,5968,2000,\\u002c", "\\u002c,5968,5968,2000,\\u002c"),
]
USER = [_row("東京タワー", 4785, -32768, "名詞,固有名詞,一般,*,*,*", "トウキョウタワー", unit="C", a="0/U1", b="0/U1"), _row("タワー", 5139, 5200, NOUN, "タワー")]
MATRIX = {(4791, 100): -300, (100, 600): -500, (601, 200): -1500, (5139, 5139): 200, (4794, 4794): -600}
