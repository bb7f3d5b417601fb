"""Compiled dictionaries: one file with a header, parts of speech, connection costs, a double array over the headwords,
word ids by headword, word parameters and word infos. Read, written, printed, and re-coded between UTF-8 and UTF-16.

A double array is a trie in 32-bit units: the children of a node lie at its base XOR their label; label 0 is the leaf
that holds the value. Words with left id -1 are units of other words only and have no key. In user dictionaries, bit 28 of
a split reference marks the dictionary's own words.
"""

from __future__ import annotations

import struct
from datetime import datetime
from typing import NamedTuple

import numpy as np

from ..operators.dictionary import Dictionary, Word

SYSTEM, USER, USER_WITH_POS = 0x7366D3F18BD111E7, 0xA50F31188BD211E7, 0x9FDEB5A90168D868
DESCRIPTION = 256
OWN = 1 << 28


# --- double array
def build_trie(keys: list[bytes], values: list[int]) -> np.ndarray:
    """Units of the trie over sorted, distinct, non-empty keys without NUL; values below 2**31."""
    if any(not k or 0 in k for k in keys) or any(a >= b for a, b in zip(keys, keys[1:])):
        raise ValueError("keys must be sorted, distinct, not empty and without NUL")
    units, used, bases = [0] * 256, bytearray(256), set()
    used[0] = 1
    free = 1

    def grow(n: int) -> None:
        while len(units) <= n:
            units.extend([0] * 256)
            used.extend(bytes(256))

    def place(at: int, labels: list[int]) -> int:
        """A base for the children of the unit at `at`: distinct bases, free places, and a distance that a unit can say."""
        nonlocal free
        while free < len(used) and used[free]:
            free += 1
        slot = free
        while True:
            grow(slot | 0xFF)
            base = slot ^ labels[0]
            far = at ^ base
            if not used[slot] and base not in bases and base and (far < 1 << 21 or not far & 0xFF and far < 1 << 29):
                grow(base | 0xFF)
                if all(not used[base ^ x] for x in labels):
                    return base
            slot += 1

    todo = [(0, 0, len(keys), 0)] if keys else []
    while todo:
        at, lo, hi, depth = todo.pop()
        groups: list[tuple[int, int, int]] = []
        i = lo
        while i < hi:
            c = keys[i][depth] if depth < len(keys[i]) else 0
            j = i + 1
            while j < hi and (keys[j][depth] if depth < len(keys[j]) else 0) == c:
                j += 1
            groups.append((c, i, j))
            i = j
        base = place(at, [c for c, _, _ in groups])
        bases.add(base)
        far = at ^ base
        units[at] |= far << 10 if far < 1 << 21 else far << 2 | 1 << 9
        for c, i, j in groups:
            child = base ^ c
            used[child] = 1
            if c:
                units[child] = c
                todo.append((child, i, j, depth + 1))
            else:
                units[at] |= 1 << 8
                units[child] = values[i] | 1 << 31
    return np.array(units, np.uint32)


def _base(at: int, unit: int) -> int:
    return at ^ (unit >> 10 << ((unit & 1 << 9) >> 6))


def prefixes(units: np.ndarray, text: bytes, at: int = 0) -> list[tuple[int, int]]:
    """(value, end) of every key that the text has at a place, the shortest first."""
    out, base = [], _base(0, int(units[0]))
    for i in range(at, len(text)):
        node = base ^ text[i]
        unit = int(units[node])
        if unit & 0x800000FF != text[i]:
            break
        base = _base(node, unit)
        if unit >> 8 & 1:
            out.append((int(units[base]) & 0x7FFFFFFF, i + 1))
    return out


def exact(units: np.ndarray, key: bytes) -> int | None:
    return next((v for v, end in prefixes(units, key) if end == len(key)), None)


def trie_keys(units: np.ndarray) -> list[tuple[bytes, int]]:
    """(key, value) of all keys, in order; a level of the trie at a time, over all its nodes at once."""
    u = units.astype(np.int64)
    base = np.array([_base(0, int(u[0]))])
    said, labels, out = [b""], np.arange(1, 256), []
    while len(base):
        child = base[:, None] ^ labels
        inside = child < len(u)
        unit = np.where(inside, u[np.minimum(child, len(u) - 1)], 0)
        hit = inside & ((unit & 0x800000FF) == labels)
        parent, k = np.nonzero(hit)
        unit, child = unit[hit], child[hit]
        base = child ^ (unit >> 10 << ((unit & 1 << 9) >> 6))
        said = [said[p] + bytes([x + 1]) for p, x in zip(parent.tolist(), k.tolist())]
        for i in np.flatnonzero(unit >> 8 & 1).tolist():
            out.append((said[i], int(u[base[i]]) & 0x7FFFFFFF))
    return sorted(out)


# --- pieces of the file
class Header(NamedTuple):
    version: int
    created: int
    description: str

    @property
    def kind(self) -> str:
        return {SYSTEM: "system dictionary", USER: "user dictionary", USER_WITH_POS: "user dictionary"}.get(self.version, "")


class _In:
    def __init__(self, data: bytes, utf16: bool):
        self.data, self.at, self.utf16 = data, 0, utf16

    def take(self, form: str):
        got = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return got[0] if len(got) == 1 else got

    def length(self) -> int:
        n = self.take("B")
        return (n & 0x7F) << 8 | self.take("B") if n & 0x80 else n

    def string(self) -> str:
        n = self.length() * (2 if self.utf16 else 1)
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-16-le" if self.utf16 else "utf-8")

    def ints(self) -> list[int]:
        n = self.take("B")
        self.at += 4 * n
        return list(struct.unpack_from(f"<{n}i", self.data, self.at - 4 * n))


def _length(n: int) -> bytes:
    if n > 32767:
        raise ValueError(f"string of {n} units")
    return bytes([n]) if n <= 127 else bytes([0x80 | n >> 8, n & 0xFF])


def _string(s: str, utf16: bool) -> bytes:
    raw = s.encode("utf-16-le" if utf16 else "utf-8")
    return _length(len(raw) // 2 if utf16 else len(raw)) + raw


class Compiled(NamedTuple):
    """What a file holds. Words have the fields of `Word`, with split references as the file has them; `keys` are the
    headwords with their word ids, in order."""

    header: Header
    pos: list[tuple[str, ...]]
    costs: np.ndarray  # [left, right]
    units: np.ndarray
    keys: list[tuple[str, list[int]]]
    words: list[Word]
    pos_ids: list[int]
    head_lengths: list[int]


def read_header(data: bytes) -> Header:
    version, created = struct.unpack_from("<Qq", data)
    return Header(version, created, data[16 : 16 + DESCRIPTION].split(b"\0")[0].decode())


def parse(data: bytes, utf16: bool = False, pos: list[tuple[str, ...]] = ()) -> Compiled:
    """A whole file; `pos` are the system's parts of speech, before a user dictionary's own."""
    header = read_header(data)
    if not header.kind:
        raise ValueError("not a dictionary")
    f = _In(data, utf16)
    f.at = 16 + DESCRIPTION
    own, costs = [], np.zeros((0, 0), np.int16)
    if header.version != USER:
        own = [tuple(f.string() for _ in range(6)) for _ in range(f.take("H"))]
        left, right = f.take("hh")
        costs = np.frombuffer(data, "<i2", left * right, f.at).reshape(right, left).T
        f.at += 2 * left * right
    every = [*pos, *own]
    n = f.take("I")
    units = np.frombuffer(data, "<u4", n, f.at)
    f.at += 4 * n
    size = f.take("I")
    table = data[f.at : f.at + size]
    f.at += size
    count = f.take("I")
    params = np.frombuffer(data, "<i2", 3 * count, f.at).reshape(-1, 3).tolist()
    f.at += 6 * count
    offsets = np.frombuffer(data, "<u4", count, f.at).tolist()
    keys = [(k.decode(), list(struct.unpack_from(f"<{table[v]}I", table, v + 1))) for k, v in trie_keys(units)]
    head = {i: k for k, ids in keys for i in ids}
    words, ids, lengths = [], [], []
    for i, at in enumerate(offsets):
        f.at = at
        surface, length, p, normalized, form, reading = f.string(), f.length(), f.take("h"), f.string(), f.take("i"), f.string()
        a, b, s = f.ints(), f.ints(), f.ints()
        unit = "A" if not a else "B" if not b else "C"
        words.append(Word(head.get(i, surface), *params[i], surface, every[p] if 0 <= p < len(every) else (), reading or surface, normalized or surface, form, unit, a, b, s))
        ids.append(p)
        lengths.append(length)
    for w in words:
        w.dictionary_form = words[w.form_id].surface if w.form_id >= 0 else w.surface
    return Compiled(header, own, costs, units, keys, words, ids, lengths)


def dump(c: Compiled, utf16: bool = False) -> bytes:
    """The file of what `parse` returns, in either coding of strings."""
    said = c.header.description.encode()
    if len(said) > DESCRIPTION:
        raise ValueError("description too long")
    out = bytearray(struct.pack("<Qq", c.header.version, c.header.created) + said.ljust(DESCRIPTION, b"\0"))
    if c.header.version != USER:
        out += struct.pack("<H", len(c.pos)) + b"".join(_string(x, utf16) for p in c.pos for x in p)
        out += struct.pack("<hh", *c.costs.shape) + np.ascontiguousarray(c.costs.T.astype("<i2")).tobytes()
    out += struct.pack("<I", len(c.units)) + c.units.astype("<u4").tobytes()
    table = b"".join(bytes([len(ids)]) + struct.pack(f"<{len(ids)}I", *ids) for _, ids in c.keys)
    out += struct.pack("<I", len(table)) + table
    out += struct.pack("<I", len(c.words)) + b"".join(struct.pack("<hhh", w.left, w.right, w.cost) for w in c.words)
    at, offsets, infos = len(out) + 4 * len(c.words), [], []
    for w, p, length in zip(c.words, c.pos_ids, c.head_lengths):
        info = _string(w.surface, utf16) + _length(length) + struct.pack("<h", p)
        info += _string("" if w.normalized == w.surface else w.normalized, utf16) + struct.pack("<i", w.form_id)
        info += _string("" if w.reading == w.surface else w.reading, utf16)
        info += b"".join(bytes([len(x)]) + struct.pack(f"<{len(x)}i", *x) for x in (w.a, w.b, w.structure))
        offsets.append(at)
        infos.append(info)
        at += len(info)
    return bytes(out) + struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(infos)


def convert(data: bytes, utf16: bool, to_utf16: bool) -> bytes:
    """The same dictionary with strings in the other coding."""
    return dump(parse(data, utf16), to_utf16)


def compiled(d: Dictionary, layer: int = 0, created: int = 0, description: str = "", sizes: tuple[int, int] | None = None) -> Compiled:
    """A layer of a dictionary as a file's contents: the system's with all connection costs, a user's with its own parts
    of speech. `sizes`: of the table of costs; by default as large as its ids ask for."""
    words = d.layers[layer]
    known = d.pos_of[layer]
    first = d.pos_first[layer]
    ids: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w.left >= 0:
            ids.setdefault(w.headword, []).append(i)
    keys = sorted(ids.items(), key=lambda x: x[0].encode())
    at, values = 0, []
    for _, own in keys:
        if len(own) > 255:
            raise ValueError("more than 255 words with one headword")
        values.append(at)
        at += 1 + 4 * len(own)
    shape = (0, 0) if layer else sizes or tuple(1 + max([-1, *(x[k] for x in d.matrix)]) for k in (0, 1))
    costs = np.zeros(shape, np.int16)
    if not layer:
        for (left, right), c in d.matrix.items():
            costs[left, right] = c
    ref = lambda refs: [(OWN | i) if layer and k else i for k, i in refs]
    out = [Word(w.headword, w.left, w.right, w.cost, w.surface, w.pos, w.reading, w.normalized, w.form_id, w.unit, ref(w.a), ref(w.b), ref(w.structure), w.dictionary_form) for w in words]
    own_pos = d.pos_list[first : first + len(known)] if layer else d.pos_list[: len(known)]
    # a user's own parts of speech are numbered from the system's last, whatever other dictionaries there are
    number = lambda w: d.pos_of[0][w.pos] if w.pos in d.pos_of[0] else len(d.pos_of[0]) + known[w.pos] - first
    return Compiled(Header(USER_WITH_POS if layer else SYSTEM, created, description), own_pos, costs, build_trie([k.encode() for k, _ in keys], values), keys, out, [number(w) for w in words], [len(w.headword.encode()) for w in words])


def load(system: bytes, users: list[bytes] = (), utf16: bool = False, cost_of=None) -> Dictionary:
    """A dictionary from files: the system's, then users' in order. Costs of -32768 are computed by cost_of."""
    s = parse(system, utf16)
    if s.header.version != SYSTEM:
        raise ValueError("not a system dictionary")
    left, right = np.nonzero(s.costs)
    d = Dictionary(None, {(a, b): int(s.costs[a, b]) for a, b in zip(left.tolist(), right.tolist())})
    for c in [s, *(parse(u, utf16, s.pos) for u in users)]:
        layer = len(d.layers)
        if layer and c.header.version == SYSTEM:
            raise ValueError("not a user dictionary")
        for w in c.words:
            for name in ("a", "b", "structure"):
                setattr(w, name, [(layer, i & ~OWN) if i & OWN else (0, i) for i in getattr(w, name)])
        d.add_words(c.words, cost_of, c.pos)
    return d


def header_lines(name: str, data: bytes) -> list[str]:
    """The header in words: file name, kind, time of creation with its zone, description."""
    h = read_header(data)
    if not h.kind:
        raise ValueError("invalid file")
    t = datetime.fromtimestamp(h.created).astimezone()
    stamp = t.isoformat(timespec="seconds").replace("+00:00", "Z")
    return [f"filename: {name}", f"type: {h.kind}", f"createTime: {stamp}[{t.tzname()}]", f"description: {h.description}"]
