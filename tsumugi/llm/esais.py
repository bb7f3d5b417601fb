"""Suffix array with common-prefix values by external induced sorting.

Suffixes that begin an S-run after an L-run (S* suffixes) are named by their substrings up to the next one; the string of
names, at most half as long, is sorted by the same method; from the sorted S* suffixes all L suffixes and then all S
suffixes are induced. Induction runs through a monotone priority queue of tuples (suffix, common prefix with the tuple
before it) with priority (first symbol, arrival): a queue per symbol, whose tuples go to disk when more than
`memory_items` are held, those needed last first. Sorted runs are parked on the same disk store until the end.

Common prefixes travel with the tuples. Two suffixes pushed one after the other into the same queue by sources with the
same first symbol share one symbol more than their sources, which is a range minimum over the sources' run; from sources
with different first symbols they share one symbol; between runs of L and S, and between rounds within a symbol, the
shorter run of that symbol decides. A symbol's long run is handled in vectors, a short one tuple by tuple, as the large
alphabets of names have them: the cost stays linear in the number of tuples.

Queues, induced runs and the result (`suffix_runs` yields it symbol by symbol) go to disk beyond `memory_items` tuples,
and substrings are named by an external merge sort. What stays in memory is the string in its narrowest type, a byte per
suffix type, and, for the third or so of suffixes that are S*, place, name and order. The recursion ends, as external induced
sorting does, at a string of names that fits the memory given (an eighth of `memory_items` symbols, or BASE), which is
sorted there by doubling.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np

from .common import drop_file, get_file, put_file


BASE = 1 << 12
SHORT = 24


def doubled(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes of a string that fits memory, by ranks of prefixes of 1, 2, 4, ... symbols."""
    n, k = len(t), 1
    ranks = [np.unique(t, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max() < n - 1:
        r = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = r[k:] + 1
        ranks.append(np.unique(r * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64))
        k *= 2
    sa = np.argsort(ranks[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    i, j = sa[:-1], sa[1:]
    for e in range(len(ranks) - 1, -1, -1):
        a, b = i + lcp[1:], j + lcp[1:]
        same = (a < n) & (b < n) & (ranks[e][np.minimum(a, n - 1)] == ranks[e][np.minimum(b, n - 1)])
        lcp[1:] += same << np.int64(e)
    return sa, lcp


class Store:
    """Arrays by key, in memory up to a number of items, beyond it in files below a URI (none: memory only)."""

    def __init__(self, uri: str | None = None, memory_items: int = 4_000_000):
        self.uri, self.most = uri, memory_items
        self.held: dict = {}
        self.items = 0
        self.files: dict = {}
        self.users: dict[str, int] = {}  # keys of which a file still holds tuples
        self.spilled = 0

    def add(self, key, a: np.ndarray) -> None:
        self.held.setdefault(key, []).append(a)
        self.items += a.shape[-1]
        if self.uri and self.items > self.most:
            keys, left = [], self.items
            for k in sorted(self.held, key=self.far, reverse=True):
                if left <= self.most // 2:
                    break
                keys.append(k)
                left -= sum(len(a) if type(a) is list else a.shape[-1] for a in self.held[k])
            self.spill(keys)

    def put(self, key, pair: tuple[int, int]) -> None:
        """One tuple, as `add` of one column."""
        held = self.held.get(key)
        if held is None:
            self.held[key] = [[pair]]
        elif type(held[-1]) is list:
            held[-1].append(pair)
        else:
            held.append([pair])
        self.items += 1
        if self.uri and self.items > self.most:
            self.add(key, np.empty((2, 0), np.int64))

    def few(self, key) -> list[tuple[int, int]] | None:
        """The key's tuples, taken out, if they are few and in memory; else None."""
        if key in self.files:
            return None
        held = self.held.get(key)
        if held is None:
            return []
        if sum(len(a) if type(a) is list else a.shape[-1] for a in held) > SHORT:
            return None
        del self.held[key]
        out = []
        for a in held:
            out += a if type(a) is list else zip(*a.tolist())
        self.items -= len(out)
        return out

    far = staticmethod(lambda key: key)

    @staticmethod
    def _arrays(parts: list) -> list[np.ndarray]:
        return [np.array(a, np.int64).T if type(a) is list else a for a in parts]

    def spill(self, keys: list) -> None:
        """These keys' tuples into one file."""
        file, at, parts = f"{self.uri}/{uuid.uuid4().hex}.run", 0, []
        for k in keys:
            a = np.concatenate(self._arrays(self.held.pop(k)), axis=-1)
            parts.append(a.astype("<i8").tobytes())
            self.files.setdefault(k, []).append((file, at, a.shape))
            at += len(parts[-1])
            self.items -= a.shape[-1]
        put_file(file, b"".join(parts))
        self.users[file] = len(keys)
        self.spilled += 1

    def take(self, key) -> np.ndarray | None:
        parts = []
        for file, at, shape in self.files.pop(key, []):
            parts.append(np.frombuffer(get_file(file, at, 8 * shape[0] * shape[1]), "<i8").reshape(shape).copy())
            self.users[file] -= 1
            if not self.users[file]:
                drop_file(file)
        for a in self._arrays(self.held.pop(key, [])):
            parts.append(a)
            self.items -= a.shape[-1]
        return None if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts, axis=-1)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both inside, lo <= hi; sparse table as deep as the longest range needs."""
    if not len(lo):
        return lo
    depth = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    rows = [values]
    for k in range(int(depth.max())):
        p = rows[-1]
        rows.append(np.minimum(p[: -(1 << k)], p[1 << k :]))
    out = np.empty(len(lo), np.int64)
    for k in range(len(rows)):
        m = depth == k
        if m.any():
            out[m] = np.minimum(rows[k][lo[m]], rows[k][hi[m] - (1 << k) + 1])
    return out


def _pushes(store: Store, t: np.ndarray, pos: np.ndarray, lcp: np.ndarray, mask: np.ndarray) -> None:
    """Push the predecessors (where mask) of a symbol's run, given in scan order, into the queues of their symbols."""
    at = np.flatnonzero(mask)
    if not len(at):
        return
    new = pos[at] - 1
    x = t[new]
    if len(at) > 1:
        order = np.argsort(x, kind="stable")
        at, new, x = at[order], new[order], x[order]
    edge = np.concatenate([[True], x[1:] != x[:-1]])
    l = np.ones(len(at), np.int64)  # sources with another first symbol before: one symbol shared
    inner = np.flatnonzero(~edge)
    if len(inner):
        l[inner] = 1 + _range_min(lcp, at[inner - 1] + 1, at[inner])
    both = np.stack([new, l])
    cuts = np.flatnonzero(edge)
    for a, b, c in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], x[cuts].tolist()):
        store.add(c, both[:, a:b])


def _own(t: np.ndarray, c: int, first: np.ndarray | None, kind: np.ndarray, want: bool) -> np.ndarray:
    """All suffixes of this symbol and type in scan order with common prefixes, from those pushed by other symbols:
    round k + 1 holds the predecessors, again of this symbol, of round k, so its runs are one longer."""
    if first is None:
        return np.empty((2, 0), np.int64)
    rounds, cur, k = [first], first, 1
    while True:
        pos = cur[0]
        m = (pos > 0) & (t[pos - 1] == c) & (kind[pos - 1] == want)
        at = np.flatnonzero(m)
        if not len(at):
            break
        l = np.empty(len(at), np.int64)
        l[0] = k  # against the last of the round before, whose run is k long
        l[1:] = 1 + _range_min(cur[1], at[:-1] + 1, at[1:])
        cur = np.stack([pos[at] - 1, l])
        rounds.append(cur)
        k += 1
    return rounds[0] if len(rounds) == 1 else np.concatenate(rounds, axis=1)


def _push_few(store: Store, t, c: int, run: list[tuple[int, int]], kind, want: bool) -> None:
    """As `_pushes`, for a short run."""
    last: dict[int, int] = {}
    for j, (pos, _) in enumerate(run):
        p = pos - 1
        if pos and bool(kind[p]) is want and (x := t[p]) != c:
            i = last.get(x)
            store.put(x, (p, 1 if i is None else 1 + min(run[k][1] for k in range(i + 1, j + 1))))
            last[x] = j


def _own_few(t, c: int, first: list[tuple[int, int]], kind, want: bool) -> list[tuple[int, int]]:
    """As `_own`, for a short run."""
    out, cur, k = list(first), first, 1
    while True:
        nxt, before = [], -1
        for j, (pos, _) in enumerate(cur):
            if pos and t[pos - 1] == c and bool(kind[pos - 1]) is want:
                nxt.append((pos - 1, k if before < 0 else 1 + min(cur[i][1] for i in range(before + 1, j + 1))))
                before = j
        if not nxt:
            return out
        out += nxt
        cur, k = nxt, k + 1


def _run_length(t: np.ndarray, at: int) -> int:
    """How often the symbol at a place stands from there on without a break."""
    c, end, step = t[at], at + 1, 16
    while end < len(t):
        other = np.flatnonzero(t[end : end + step] != c)
        if len(other):
            return end + int(other[0]) - at
        end, step = min(len(t), end + step), step * 4
    return end - at


def _types(t: np.ndarray) -> np.ndarray:
    """True for S: the next different symbol is larger; the end is smaller than all. In blocks, from the right."""
    n, step = len(t), 1 << 17
    out = np.empty(n, bool)
    later = False  # of the suffix behind the block; the last one is L
    for hi in range(n, 0, -step):
        lo = max(0, hi - step)
        here, nxt = t[lo:hi], t[lo + 1 : hi + 1]
        if hi == n:
            nxt = np.append(nxt, t.dtype.type(0))
        differs = np.flatnonzero(here != nxt)
        at = np.searchsorted(differs, np.arange(hi - lo))
        up = np.append(here[differs] < nxt[differs], later)
        out[lo:hi] = up[at]
        later = bool(out[lo])
    return out


def suffix_array(t: np.ndarray, uri: str | None = None, memory_items: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before it) of symbols >= 1; 0 is the end's own symbol."""
    parts = list(suffix_runs(t, uri, memory_items))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))


def suffix_runs(t: np.ndarray, uri: str | None = None, memory_items: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`suffix_array` in parts, a first symbol each."""
    t = np.asarray(t)
    n = len(t)
    if n < 2:
        if n:
            yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    t = t.astype(np.min_scalar_type(int(t.max()) + 1), copy=False)
    is_s = _types(t)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(star):
        sa_star, lcp_star = _stars(t, star, uri, memory_items)
    else:
        sa_star, lcp_star = np.empty(0, np.int64), np.empty(0, np.int64)
    heads = t[sa_star]  # ascending
    b = 0
    del star

    # single places are read through these: no array scalar is made for each
    tv, sv = memoryview(t), memoryview(is_s.view(np.uint8))
    symbols = np.unique(t)
    queue, done = Store(uri, memory_items), Store(uri, memory_items)
    done.far = lambda key: -key
    queue.add(int(t[n - 1]), np.array([[n - 1], [0]]))
    for c in map(int, symbols):
        a = b
        if a < len(heads) and heads[a] == c:
            b = a + SHORT + 1
            b = int(np.searchsorted(heads, heads[a], side="right")) if b < len(heads) and heads[b] == c else a + int(np.count_nonzero(heads[a:b] == c))
        few = queue.few(c) if b - a <= SHORT else None
        if few is not None:
            own = _own_few(tv, c, few, sv, False) if few else few
            if own:
                own[0] = (own[0][0], 0)
                for pair in own:
                    done.put(c, pair)
            if b > a:
                tail = list(zip(sa_star[a:b].tolist(), lcp_star[a:b].tolist()))
                tail[0] = (tail[0][0], min(_run_length(t, own[-1][0]), _run_length(t, tail[0][0])) if own else 0)
                own = own + tail
            if own:
                _push_few(queue, tv, c, own, sv, False)
            continue
        own = _own(t, c, queue.take(c), is_s, False)
        pos, lcp = own
        if len(pos):
            own[1][0] = 0
            done.add(c, own)
        if b > a:
            l = lcp_star[a:b].copy()
            l[0] = min(_run_length(t, int(pos[-1])), _run_length(t, int(sa_star[a]))) if len(pos) else 0
            pos, lcp = np.concatenate([pos, sa_star[a:b]]), np.concatenate([lcp, l])
        if len(pos):
            before = np.maximum(pos - 1, 0)
            _pushes(queue, t, pos, lcp, (pos > 0) & ~is_s[before] & (t[before] != c))
    del sa_star, lcp_star, heads
    queue, left = Store(uri, memory_items), Store(uri, memory_items)
    queue.far = lambda key: -key
    for c in map(int, symbols[::-1]):
        few = queue.few(c)
        large = done.few(c) if few is not None else None
        if few is not None and large is not None:
            down = _own_few(tv, c, few, sv, True) if few else few
            if down:
                down[0] = (down[0][0], 0)
            if large:
                back = [(p, large[i + 1][1] if i + 1 < len(large) else 0) for i, (p, _) in enumerate(large)][::-1]
                back[0] = (back[0][0], min(_run_length(t, down[-1][0]), _run_length(t, back[0][0])) if down else 0)
                down = down + back
            if down:
                _push_few(queue, tv, c, down, sv, True)
                for i in range(len(down) - 1, -1, -1):
                    left.put(c, (down[i][0], down[i + 1][1] if i + 1 < len(down) else 0))
            continue
        if few:
            queue.add(c, np.array(few, np.int64).T)
        down = _own(t, c, queue.take(c), is_s, True)
        large = done.take(c)
        pos, lcp = down
        if len(pos):
            down[1][0] = 0
        if large is not None:
            p = large[0][::-1]
            l = np.empty(len(p), np.int64)
            l[1:] = large[1][:0:-1]
            l[0] = min(_run_length(t, int(pos[-1])), _run_length(t, int(p[0]))) if len(pos) else 0
            pos, lcp = np.concatenate([pos, p]), np.concatenate([lcp, l])
        if len(pos):
            before = np.maximum(pos - 1, 0)
            _pushes(queue, t, pos, lcp, (pos > 0) & is_s[before] & (t[before] != c))
            left.add(c, np.stack([pos[::-1], np.concatenate([[0], lcp[:0:-1]])]))
    del queue, done, is_s, sv
    held: list[np.ndarray] = []
    size = 0
    for c in map(int, symbols):
        held.append(left.take(c))
        size += held[-1].shape[1]
        if size > 1 << 16:
            yield tuple(np.concatenate(held, axis=1))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(held, axis=1))


def _names(t: np.ndarray, star: np.ndarray, uri: str | None, memory_items: int) -> np.ndarray:
    """Ranks from 1 of the substrings from each S* place to the next one's first symbol, by an external merge sort: sorted
    runs of bounded size in files of some thousand substrings each, then one merge."""
    n, top = len(t), b"\xff\xff\xff\xff"
    ends = np.append(star[1:], n)
    r = np.empty(len(star), np.int64)
    most = max(1, memory_items // 4) if uri else n + 1
    part = max(256, memory_items // 256)  # of each of 64 runs a part is held in a merge
    runs: list[list[str]] = []

    def some(lo: int, hi: int) -> list[tuple[bytes, int]]:
        first, stop = int(star[lo]), int(ends[hi - 1])
        raw = np.concatenate([t[first : stop + 1], np.zeros(int(stop == n), t.dtype)]).astype(">u4").tobytes()
        # what goes on beyond where another ends is the smaller one
        return sorted((raw[4 * (a - first) : 4 * (b - first) + 4] + top, i) for i, a, b in zip(range(lo, hi), star[lo:hi].tolist(), ends[lo:hi].tolist()))

    def parted(rows: list[tuple[bytes, int]]) -> list[str]:
        names = []
        for at in range(0, len(rows), part):
            names.append(f"{uri}/{uuid.uuid4().hex}.sub")
            put_file(names[-1], pickle.dumps(rows[at : at + part]))
        return names

    def read(names: list[str]):
        for name in names:
            yield from pickle.loads(get_file(name))
            drop_file(name)

    lo = 0
    while lo < len(star):
        hi = max(lo + 1, int(np.searchsorted(ends, star[lo] + most, side="right")))
        if lo == 0 and hi >= len(star):
            merged = some(0, len(star))
            break
        runs.append(parted(some(lo, hi)))
        lo = hi
    else:
        while len(runs) > 64:  # bounds what a merge holds at once
            runs = [parted_stream(heapq.merge(*map(read, runs[i : i + 64])), parted) for i in range(0, len(runs), 64)]
        merged = heapq.merge(*map(read, runs))
    rank, before = 0, None
    for sub, i in merged:
        if sub != before:
            rank, before = rank + 1, sub
        r[i] = rank
    return r


def parted_stream(rows, parted) -> list[str]:
    """Files of a stream of rows, by `parted` a few thousand at a time."""
    from itertools import islice

    names: list[str] = []
    while some := list(islice(rows, 4096)):
        names += parted(some)
    return names


def _stars(t: np.ndarray, star: np.ndarray, uri: str | None, memory_items: int):
    """Sorted S* suffixes with common prefixes, by names and recursion."""
    n = len(t)
    r = _names(t, star, uri, memory_items)
    if int(r.max()) == len(r):
        order = np.argsort(r, kind="stable")
        same = np.zeros(len(r), np.int64)
    elif len(r) <= max(BASE, memory_items // 8):
        order, same = doubled(r)
    else:
        order, same = suffix_array(r, uri, memory_items)
    del r
    starts = np.append(star, n)
    sa = star[order]
    lcp = np.zeros(len(order), np.int64)
    step = 1 << 18
    for lo in range(1, len(order), step):
        hi = min(len(order), lo + step)
        a, k = order[lo - 1 : hi - 1], same[lo:hi]
        lcp[lo:hi] = starts[np.minimum(a + k, len(star))] - star[a]
        # past the equal names, symbols are compared until they differ
        x, y = sa[lo - 1 : hi - 1] + lcp[lo:hi], sa[lo:hi] + lcp[lo:hi]
        live = np.arange(hi - lo)
        while len(live):
            i, j = x[live], y[live]
            live = live[(i < n) & (j < n) & (t[np.minimum(i, n - 1)] == t[np.minimum(j, n - 1)])]
            x[live] += 1
            y[live] += 1
            lcp[lo + live] += 1
    return sa, lcp
