"""Character categories, and what follows from them: runs of one category and places where a word may begin."""

from __future__ import annotations

NAMES = ["DEFAULT", "SPACE", "KANJI", "SYMBOL", "NUMERIC", "ALPHA", "HIRAGANA", "KATAKANA", "KANJINUMERIC", "GREEK", "CYRILLIC", "USER1", "USER2", "USER3", "USER4", "NOOOVBOW"]
BIT = {name: 1 << i for i, name in enumerate(NAMES)}
#: code point ranges by category, hexadecimal; a code point has the categories of all ranges that it is in
_TABLE = {
    "SPACE": "9-b d 20",
    "SYMBOL": "21-2f 3a-40 5b-60 7b-7e a1-bf d7 f7 ff01-ff0f ff1a-ff20 ff3b-ff40 ff5b-ff65 ffe0-ffef 2000-206f 20a0-214f 2190-23ff 2460-24ff 2501-26fe 2700-297f 2a00-2bff 3200-32fe 3300-33ff 3000-303f fe30-fe4f fe50-fe6b",
    "NUMERIC": "30-39 ff10-ff19 2070-209f 2150-218f",
    "ALPHA": "41-5a 61-7a c0-d6 d8-f6 f8-236 1e00-1ef9 ff21-ff3a ff41-ff5a",
    "CYRILLIC": "400-4f9 500-50f",
    "GREEK": "374-3fb",
    "HIRAGANA": "3041-309f",
    "KATAKANA": "30a1-30fa 30fc-30ff 31f0-31ff ff66-ff9f 309b-309c",
    "NOOOVBOW": "30a1 30a3 30a5 30a7 30a9 30e3 30e5 30e7 30ee 30fb-30fe 3005",
    "KANJI": "2e80-2ef3 2f00-2fd5 3005 3007 3400-4db5 4e00-9fff f900-fa2d fa30-fa6a",
    "KANJINUMERIC": "3007 " + " ".join(f"{ord(c):x}" for c in "一二三四五六七八九十百千万億兆"),
}


def ranges() -> list[tuple[int, int, int]]:
    """(low, high, mask) of the default table."""
    out = []
    for name, spec in _TABLE.items():
        for part in spec.split():
            low, _, high = part.partition("-")
            out.append((int(low, 16), int(high or low, 16), BIT[name]))
    return sorted(out)


def mask_of(names: list[str]) -> int:
    mask = 0
    for n in names:
        mask |= BIT[n]
    return mask


class Categories:
    """Masks of code points: all matching ranges together, DEFAULT where none matches."""

    def __init__(self, table: list[tuple[int, int, int]] | None = None):
        self.table = ranges() if table is None else table
        self.known: dict[str, int] = {}

    def mask(self, ch: str) -> int:
        m = self.known.get(ch)
        if m is None:
            c, m = ord(ch), 0
            for low, high, bits in self.table:
                if low <= c <= high:
                    m |= bits
            m = self.known[ch] = m or BIT["DEFAULT"]
        return m

    def masks(self, text) -> list[int]:
        return list(map(self.mask, text))

    def classes(self) -> dict[int, str]:
        """Regex class bodies of the code points that have exactly one category, by mask."""
        edges = sorted({x for low, high, _ in self.table for x in (low, high + 1)})
        out: dict[int, list[str]] = {}
        for a, b in zip(edges, edges[1:]):
            m = self.mask(chr(a)) if not 0xD800 <= a < 0xE000 else 0
            if m and m != 1 and m & (m - 1) == 0:
                out.setdefault(m, []).append(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}")
        return {m: "".join(v) for m, v in out.items()}


def run_ends(masks: list[int]) -> list[int]:
    """For each place the end of its run: a run goes on while characters share a bit with its first character."""
    out, n, i = [0] * len(masks), len(masks), 0
    while i < n:
        j = i + 1
        while j < n and masks[i] & masks[j]:
            j += 1
        out[i:j] = [j] * (j - i)
        i = j
    return out


def can_begin(masks: list[int]) -> list[bool]:
    """Letters of alphabets begin a word only where they share no category with the character before."""
    letters = BIT["ALPHA"] | BIT["GREEK"] | BIT["CYRILLIC"]
    return [i == 0 or not m & letters or not m & masks[i - 1] for i, m in enumerate(masks)]


def span_mask(masks: list[int], ends: list[int], begin: int, end: int) -> int:
    """Categories that all characters of a span have; none if it leaves the run it begins in."""
    if begin >= end or ends[begin] < end:
        return 0
    m = masks[begin]
    for x in masks[begin + 1 : end]:
        m &= x
    return m
