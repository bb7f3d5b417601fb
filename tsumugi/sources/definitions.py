"""Readers of the plain-text definition formats, on lists of lines (small files, read on the driver), and default tables."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from ..functions.chars import BIT, mask_of

#: unknown words by category: left id = right id, cost, part of speech
_POS = {
    "5139": "名詞,普通名詞,一般,*,*,*", "5129": "名詞,普通名詞,サ変可能,*,*,*", "4785": "名詞,固有名詞,一般,*,*,*", "4787": "名詞,固有名詞,人名,一般,*,*",
    "4791": "名詞,固有名詞,地名,一般,*,*", "4794": "名詞,数詞,*,*,*,*", "5687": "感動詞,一般,*,*,*,*", "5966": "空白,*,*,*,*,*", "5968": "補助記号,一般,*,*,*,*",
}
_UNKNOWN = {
    "DEFAULT": "5968:3857", "SPACE": "5966:6056", "SYMBOL": "5129:17094", "NUMERIC": "4794:12450", "KANJINUMERIC": "4794:14170",
    "KANJI": "5139:14657 5129:17308 4785:18181 4787:18086 4791:19198", "ALPHA": "5139:11633 4785:13620 4787:14228 4791:15793 5687:15246",
    "HIRAGANA": "5139:16012 5129:20012 4785:18282 4787:18269 4791:20474 5687:17786", "KATAKANA": "5139:10980 5129:14802 4785:13451 4787:13759 4791:14554 5687:15272",
    "GREEK": "5139:11051 4785:13353 4787:13671 4791:14862", "CYRILLIC": "5139:11140 4785:13174 4787:13495 4791:14700",
}
#: category: (always propose, propose the whole run, longest prefix proposed)
PROPERTIES = {"DEFAULT": (0, 1, 0), "SPACE": (0, 1, 0), "KANJI": (0, 0, 2), "SYMBOL": (1, 1, 0), "NUMERIC": (1, 1, 0), "ALPHA": (1, 1, 0), "HIRAGANA": (0, 1, 2), "KATAKANA": (1, 1, 2), "KANJINUMERIC": (0, 1, 0), "GREEK": (1, 1, 0), "CYRILLIC": (1, 1, 0)}
UNKNOWN = [(cat, int(e.split(":")[0]), int(e.split(":")[0]), int(e.split(":")[1]), tuple(_POS[e.split(":")[0]].split(","))) for cat, spec in _UNKNOWN.items() for e in spec.split()]


def lines(text: str, comments: bool = True) -> list[tuple[int, str]]:
    """Numbered lines; blank ones, and those that begin with #, are left out where comments are."""
    out = [(i, x) for i, x in enumerate(text.splitlines(), 1)]
    return [(i, x) for i, x in out if x.strip() and not x.startswith("#")] if comments else out


def char_ranges(text: str) -> list[tuple[int, int, int]]:
    """`0xA..0xB CAT ...  # comment` lines of a character definition."""
    out = []
    for no, x in lines(text):
        if not x.lower().startswith("0x"):
            continue
        parts = x.split("#")[0].split()
        low, _, high = parts[0].partition("..")
        a, b = int(low, 16), int(high or low, 16)
        bad = [p for p in parts[1:] if p not in BIT]
        if a > b or bad or len(parts) < 2:
            raise ValueError(f"line {no}: {x}")
        out.append((a, b, mask_of(parts[1:])))
    return out


def char_properties(text: str) -> dict[str, tuple[int, int, int]]:
    """`NAME invoke group length` lines of a character definition."""
    out: dict[str, tuple[int, int, int]] = {}
    for no, x in lines(text):
        if x.lower().startswith("0x"):
            continue
        p = x.split("#")[0].split()
        if len(p) < 4 or p[0] not in BIT or p[0] in out:
            raise ValueError(f"line {no}: {x}")
        out[p[0]] = (int(p[1]), int(p[2]), int(p[3]))
    return out


def unknown_words(text: str, properties: dict, pos: set | None = None) -> list[tuple]:
    """`CAT,left,right,cost,p0..p5` lines; the category must have properties, the part of speech must be known."""
    out = []
    for no, x in lines(text, comments=False):
        p = x.split(",")
        if len(p) < 10 or p[0] not in properties or pos is not None and tuple(p[4:10]) not in pos:
            raise ValueError(f"line {no}: {x}")
        out.append((p[0], int(p[1]), int(p[2]), int(p[3]), tuple(p[4:10])))
    return out


def rewrite_rules(text: str) -> tuple[frozenset, dict[str, str]]:
    """One field: a character that keeps its form; two: a replacement. A key that is defined twice is an error."""
    keep, replace = set(), {}
    for no, x in lines(text):
        p = x.split()
        if len(p) == 1 and len(p[0]) == 1:
            keep.add(p[0])
        elif len(p) == 2 and p[0] not in replace:
            replace[p[0]] = p[1]
        else:
            raise ValueError(f"line {no}: {x}")
    return frozenset(keep), replace


def matrix(text: str) -> dict[tuple[int, int], int]:
    """Connection costs `left right cost` after a header of sizes; cells that aren't named cost 0, short rows are skipped."""
    rows = lines(text)
    sizes = tuple(map(int, rows[0][1].split()[:2]))
    out = {}
    for no, x in rows[1:]:
        p = x.split()
        if len(p) < 3:
            continue
        a, b, c = map(int, p[:3])
        if not (0 <= a < sizes[0] and 0 <= b < sizes[1]):
            raise ValueError(f"line {no}: {x}")
        out[a, b] = c
    return out


@dataclass
class Settings:
    """Options of a tokenizer; `then` gives later settings precedence and adds their user dictionaries."""

    path: str | None = None
    system_dict: str | None = None
    char_def: str | None = None
    user_dict: list[str] = field(default_factory=list)
    text_plugins: list[dict] | None = None
    oov_plugins: list[dict] | None = None
    path_plugins: list[dict] | None = None
    cost_plugins: list[dict] | None = None

    @classmethod
    def parse(cls, text: str, resource_dir: str | None = None) -> Settings:
        """Keys are matched without regard to case; unknown keys are ignored; relative paths are below `path`."""
        raw = {k.lower(): v for k, v in json.loads(text).items()}
        base = raw.get("path") or resource_dir
        at = lambda p: p if not p or not base or os.path.isabs(p) else os.path.join(base, p)
        plugins = lambda key: None if key not in raw else [p | {"kind": (p.get("name") or p.get("class") or "").rsplit(".", 1)[-1].rsplit("/", 1)[-1].removesuffix("Plugin")} for p in raw[key]]
        return cls(base, at(raw.get("systemdict")), at(raw.get("characterdefinitionfile")), [at(p) for p in raw.get("userdict", [])], plugins("inputtextplugin"), plugins("oovproviderplugin"), plugins("pathrewriteplugin"), plugins("editconnectioncostplugin"))

    def then(self, later: Settings) -> Settings:
        pick = lambda name: getattr(later, name) if getattr(later, name) is not None else getattr(self, name)
        return Settings(pick("path"), pick("system_dict"), pick("char_def"), self.user_dict + later.user_dict, pick("text_plugins"), pick("oov_plugins"), pick("path_plugins"), pick("cost_plugins"))
