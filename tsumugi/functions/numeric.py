"""Numerals of digits and of Chinese characters, with commas, points and units, as digit strings.

`compat="reference"` keeps two known oddities: a point is an error, and zeros filled in when a group is added are scaled
again (二千三百 becomes 230000). `compat="intent"` gives the values that are meant.
"""

from __future__ import annotations

DIGITS = {c: i for i, c in enumerate("0123456789")} | {c: i for i, c in enumerate("〇一二三四五六七八九")}
SMALL, LARGE = {"十": 1, "百": 2, "千": 3}, {"万": 4, "億": 8, "兆": 12}


class _Number:
    """Digits, a power of ten, and the place of a point (none: -1)."""

    def __init__(self):
        self.digits, self.scale, self.point = "", 0, -1

    def settle(self):
        if self.point >= 0:
            after = len(self.digits) - self.point
            if after > self.scale:
                self.point, self.scale = self.point + self.scale, 0
            else:
                self.scale, self.point = self.scale - after, -1

    def shift(self, by: int):
        self.digits = self.digits or "1"
        self.scale += by

    def text(self) -> str:
        """The number as written; settles it, and leaves the digits so."""
        if not self.digits:
            return "0"
        self.settle()
        if self.scale > 0:
            self.digits += "0" * self.scale
        elif self.point >= 0:
            s = ("0." + self.digits) if self.point == 0 else self.digits[: self.point] + "." + self.digits[self.point :]
            self.digits = s.rstrip("0").removesuffix(".")
        return self.digits

    def add(self, other: _Number, compat: str) -> bool:
        if not other.digits:
            return True
        if not self.digits:
            self.digits, self.scale, self.point = other.digits, other.scale, other.point
            return True
        other.settle()
        length = other.point if other.point >= 0 else len(other.digits) + other.scale
        if self.scale < length:
            return False
        self.digits += "0" * (self.scale - length)
        if other.point >= 0:
            self.point = len(self.digits) + other.point
        if compat == "reference":
            other.text()
        self.digits += other.digits
        self.scale = other.scale
        return True


class Parser:
    def __init__(self, compat: str = "reference"):
        if compat not in ("reference", "intent"):
            raise ValueError(compat)
        self.compat = compat
        self.clear()

    def clear(self):
        self.total, self.sub, self.tmp = _Number(), _Number(), _Number()
        self.length, self.first, self.comma, self.hanging, self.error = 0, True, False, False, "none"
        self.zero = True

    def comma_ok(self) -> bool:
        if self.first:
            return False
        return self.length == 3 if self.comma else self.length <= 3 and bool(self.tmp.digits) and not self.zero

    def _group(self):
        self.tmp, self.zero = _Number(), True
        self.first, self.length, self.comma = True, 0, False

    def append(self, c: str) -> bool:
        if c == ".":
            self.hanging = True
            if self.first:
                self.error = "point"
                return False
            if self.comma and not self.comma_ok():
                self.error = "comma"
                return False
            fits = self.tmp.scale == 0 and self.tmp.point < 0
            if fits:
                self.tmp.point = len(self.tmp.digits)
            if fits == (self.compat == "reference"):
                self.error = "point"
                return False
            self.comma = False
            return True
        if c == ",":
            if not self.comma_ok():
                self.error = "comma"
                return False
            self.comma, self.length = True, 0
            return True
        if c in SMALL:
            self.tmp.shift(SMALL[c])
            if not self.sub.add(self.tmp, self.compat):
                return False
            self._group()
        elif c in LARGE:
            if not self.sub.add(self.tmp, self.compat) or not self.sub.digits:
                return False
            self.sub.shift(LARGE[c])
            if not self.total.add(self.sub, self.compat):
                return False
            self.sub = _Number()
            self._group()
        elif c in DIGITS:
            self.tmp.digits += str(DIGITS[c])
            self.zero &= DIGITS[c] == 0
            self.first, self.hanging = False, False
            self.length += 1
        else:
            return False
        return True

    def done(self) -> bool:
        ok = self.sub.add(self.tmp, self.compat) and self.total.add(self.sub, self.compat)
        if self.hanging:
            self.error = "point"
            return False
        if self.comma and self.length != 3:
            self.error = "comma"
            return False
        return ok

    def value(self) -> str:
        return self.total.text()


def parse(text: str, compat: str = "reference") -> tuple[bool, str, str | None]:
    """(accepted, error, value) of a whole string."""
    p = Parser(compat)
    for c in text:
        if not p.append(c):
            return False, p.error, None
    ok = p.done()
    return ok, p.error, p.value() if ok else None
