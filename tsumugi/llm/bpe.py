"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of every distinct word of a batch. A sequence of tokens is the BPE encoding of
its bytes exactly if each adjacent pair is the encoding of the pair's own bytes, so one vectorised look-up tests all
adjacent pairs of all words at once; pairs not met before are decided by merging their few bytes. Only words with a pair
that fails (or a lone token that isn't its own encoding) are merged exactly.

Nulls count as empty text; empty text gives no tokens and decodes to "". A text of any length is one row: merging a long
word takes a heap, O(n log n). Repeated rows give repeated results. Other columns of the input stay untouched unless
they bear the name of an output column, in which case they are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

#: White_Space of Unicode: what \s means to the tokenizers library. Python's own \s has four control characters more.
WS = "\t-\r \x85\xa0  -     　"
#: A chunk is a run of non-space with at most the one space before it; no piece of the pattern goes beyond one.
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS + r"\p{L}\p{N}]+|[" + WS + r"]+(?![^" + WS + r"])|[" + WS + r"]+"
CACHE_WORDS = 300_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Byte-level BPE of a tokenizers JSON file (no normalizer, GPT-2 pattern, added tokens matched in the raw text)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], _byte_alphabet()
        self.id_of = {bytes(back[c] for c in w): i for w, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.id_of.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for w, i in self.id_of.items():
            self.bytes_of[i] = w
        for w, i in self.added.items():
            self.bytes_of[i] = w.encode()
        to_id = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[to_id[a], to_id[b]] = (rank, to_id[a + b])
        self.longest: dict[bytes, int] = {}  # of the tokens that begin with these four bytes
        for w in self.id_of:
            if len(w) > 3:
                self.longest[w[:4]] = max(self.longest.get(w[:4], 0), len(w))
        self.name = list(map(str, range(size)))
        self.piece = regex.compile(PIECE)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.keys, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.alone: dict[int, bool] = {}
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.cache_words = cache_words
        self.merged_words = 0

    # --- speculate
    def greedy(self, w: bytes) -> list[int]:
        ids, at, n, id_of, longest = [], 0, len(w), self.id_of, self.longest
        while at < n:
            for k in range(min(longest.get(w[at : at + 4], 3), n - at), 0, -1):
                t = id_of.get(w[at : at + k])
                if t is not None:
                    break
            ids.append(t)
            at += k
        return ids

    # --- exact
    def merge(self, w: bytes) -> list[int]:
        ids = [self.id_of[w[i : i + 1]] for i in range(len(w))]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.merges.get, (1 << 60, -1)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), none)
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (m := merges.get((ids[x], ids[right[x]]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[right[x]], m[1]))
        return [t for t in ids if t >= 0]

    # --- verify
    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """For each key left << 32 | right: is the pair the encoding of its own bytes?"""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.unique(keys[~known])
        if len(new):
            fits = np.array([self.merge(self.bytes_of[k >> 32] + self.bytes_of[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()], bool)
            every = np.concatenate([self.keys, new])
            order = np.argsort(every, kind="stable")
            self.keys, self.fits = every[order], np.concatenate([self.fits, fits])[order]
            if len(self.keys) > 4_000_000:  # a cache; what is dropped is decided again
                self.keys, self.fits = new, fits
                return self._fit(keys)
        return self.fits[np.searchsorted(self.keys, keys)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Proposals for all words, one vectorised test of all adjacent pairs, merging for those that fail."""
        props = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, props), np.int64, len(props))
        flat = np.fromiter((t for p in props for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(props)), sizes)
        good = np.ones(len(props), bool)
        if len(flat) > 1:
            same = word[1:] == word[:-1]
            keys = (flat[:-1] << 32 | flat[1:])[same]
            good[word[1:][same][~self._fit(keys)]] = False
        for i in np.flatnonzero(sizes == 1).tolist():
            t = props[i][0]
            if t not in self.alone:
                self.alone[t] = self.merge(words[i]) == [t]
            good[i] &= self.alone[t]
        for i in np.flatnonzero(~good).tolist():
            props[i] = self.merge(words[i])
            self.merged_words += 1
        return props

    # --- texts
    def chunks(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.added):
            return CHUNK.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += ["\0" + part] if k % 2 else CHUNK.findall(part)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the encodings of these chunks into the cache; a chunk that begins with NUL may be an added token."""
        new = list(chunks)
        pieces = [["\0"] if c[:1] == "\0" and c[1:] in self.added else self.piece.findall(c) for c in new]
        words, name = list({p for ps in pieces for p in ps if p != "\0"}), self.name
        ids = dict(zip(words, self.encode_words([w.encode() for w in words])))
        for c, ps in zip(new, pieces):
            t = [self.added[c[1:]]] if ps == ["\0"] and c != "\0" else [t for p in ps for t in (ids[p] if p in ids else self.encode_words([p.encode()])[0])]
            self.cache[c] = (array("I", t).tobytes(), ",".join([name[i] for i in t]))

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decimal ids joined by commas) of each text; texts are handled in blocks of bounded size."""
        block, size = [], 0
        for t in texts:
            block.append(self.chunks(t or ""))
            size += len(block[-1])
            if size > 400_000:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[tuple[np.ndarray, str]]:
        if len(self.cache) > self.cache_words:  # two generations: what is in use survives
            self.cache, self.older = {}, self.cache
        missing = set().union(*block).difference(self.cache)
        for c in missing.intersection(self.older):
            self.cache[c] = self.older[c]
        self.learn(missing.difference(self.older))
        get = self.cache.__getitem__
        for cs in block:
            both = [get(c) for c in cs]
            yield np.frombuffer(b"".join([x[0] for x in both]), np.uint32), ",".join([x[1] for x in both])

    def decode(self, ids) -> str:
        """Bytes of the ids, in UTF-8; bytes that aren't valid become U+FFFD."""
        get = self.bytes_of.__getitem__
        return b"".join(map(get, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _map(df: DataFrame, fields: list[T.StructField], fn) -> DataFrame:
    """df plus new columns from one pass over Arrow batches; columns of these names are replaced."""
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    import pyarrow as pa

    def run(batches):
        for b in batches:
            cols = fn(b)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *cols], names=[*kept, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out array<int>`, the token ids of column `text`."""
    import pyarrow as pa

    path = path or default_path()

    def fn(b):
        got = [ids.astype(np.int32) for ids, _ in loaded(path).encode_batch(b.column(b.schema.get_field_index(text)).to_pylist())]
        ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *got])))]

    return _map(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], fn)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out string`, the text of the token ids in column `ids` (null: empty)."""
    import pyarrow as pa

    path = path or default_path()

    def fn(b):
        bpe = loaded(path)
        return [pa.array([bpe.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())]

    return _map(df, [T.StructField(out, T.StringType())], fn)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encode, then decode the ids, keep the digests."""
    import pyarrow as pa

    path = path or default_path()

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            ids_of, texts = b.column(0), b.column(1).to_pylist()
            rows = [
                (len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                for ids, said in bpe.encode_batch(texts)
            ]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
