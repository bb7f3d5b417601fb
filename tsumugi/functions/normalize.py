"""Text normalisation with offsets into the original: literal replacements, lower case and NFKC per character, and
squeezing of prolonged sound marks. A text is (characters, original place of each, with one more for the end)."""

from __future__ import annotations

import unicodedata

#: characters that are lower-cased but keep their form
KEEP = frozenset(chr(c) for a, b in ((0x2160, 0x217F), (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x309B, 0x309C), (0xF900, 0xFA6D), (0xFA70, 0xFAD9)) for c in range(a, b + 1))
MARKS = ("ー", "-", "⁓", "〜", "〰")


def replacements() -> dict[str, str]:
    """A kana and a voiced or semi-voiced sound mark, in any of their widths, become the one composed kana."""
    voiced = "うかきくけこさしすせそたちつてとはひふへほウカキクケコサシスセソタチツテトハヒフヘホ"
    half, semi = "はひふへほハヒフヘホ", {}
    out = {}
    for bases, mark, marks in ((voiced, "゙", "ﾞ゙゛"), (half, "゚", "ﾟ゚゜")):
        for m in marks:
            for b in bases:
                out[b + m] = unicodedata.normalize("NFC", b + mark)
    narrow = {unicodedata.normalize("NFKC", chr(c)): chr(c) for c in range(0xFF66, 0xFF9E)}
    for bases, mark, m in ((voiced, "゙", "ﾞ"), (half, "゚", "ﾟ")):
        for b in bases:
            if b in narrow:
                out[narrow[b] + m] = unicodedata.normalize("NFC", b + mark)
    return out | semi


REPLACE = replacements()


def one(ch: str, keep=KEEP) -> str:
    """Lower case of one character, then NFKC of it alone unless it is to be kept; one code point stays one when lower
    case would make two."""
    low = ch.lower()
    if len(low) != 1:
        low = low[0]
    return low if low in keep else unicodedata.normalize("NFKC", low)


class Normalizer:
    def __init__(self, replace: dict[str, str] | None = None, keep=KEEP):
        self.replace = REPLACE if replace is None else replace
        self.keep = keep
        self.longest = max(map(len, self.replace), default=0)
        self.known: dict[str, str] = {}

    def __call__(self, text: str) -> tuple[list[str], list[int]]:
        chars: list[str] = []
        places: list[int] = []
        i, n, known = 0, len(text), self.known
        while i < n:
            for k in range(min(self.longest, n - i), 0, -1):
                to = self.replace.get(text[i : i + k])
                if to is not None:
                    break
            else:
                k = 1
                to = known.get(text[i])
                if to is None:
                    to = known[text[i]] = one(text[i], self.keep)
            chars += to
            places += [i] * len(to)
            i += k
        return chars, [*places, n]


def squeeze(chars: list[str], places: list[int], marks=MARKS, to: str = "ー") -> tuple[list[str], list[int]]:
    """Two or more prolonged sound marks in a row become one symbol; a single one stays."""
    out, at, i, n = [], [], 0, len(chars)
    while i < n:
        j = i
        while j < n and chars[j] in marks:
            j += 1
        if j - i > 1:
            out += to
            at += [places[i]] * len(to)
            i = j
        else:
            out.append(chars[i])
            at.append(places[i])
            i += 1
    return out, [*at, places[-1]]
