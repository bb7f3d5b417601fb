"""Token-ID output: one wavelet matrix per shard.

A shard file holds the token ids of consecutive documents as bit-planes, highest bit first; after each plane the tokens
are stably parted, zeros before ones. With counts of ones per 512 bits, rank and select are constant-time, so a reader
of the one compressed file gets the token at a place, counts a token within a range, and lists a token's occurrences
without unpacking the tokens. `op4_wavelet` encodes with the tokenizers library, appends an end id to each document,
writes shards in ascending doc_id order, reads them back and reports each document from what it read: ends and first
ids by access, end ids by rank, checksums from one inversion of all planes, which is cheaper than access token by token.

Null and empty texts hold only the end id. A document is never split between shards; one that is longer than a shard's
usual size gets a shard of its own. Rows with the same doc_id stay rows of their own, in the order of their texts'
hashes. An empty table gives no file and no row. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_alphabet
from .common import get_file, new_folder, prefix_sums, put_file, small_batches, table, written

MAGIC = b"TSWM0001"
SHARD_TOKENS = 1 << 20
BLOCK = 512


class WaveletMatrix:
    """Bit-planes with rank directories over `n` symbols below 2**bits."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self._ones: list[np.ndarray | None] = [None] * bits

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        v = values.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = np.zeros(bits, np.int64), []
        spare, one = np.empty_like(v), np.empty(len(v), bool)
        for k in range(bits):
            np.not_equal(v & v.dtype.type(1 << (bits - 1 - k)), 0, out=one)
            planes.append(np.packbits(one, bitorder="little"))
            zeros[k] = z = len(v) - np.count_nonzero(one)
            np.compress(one, v, out=spare[z:])
            np.compress(np.logical_not(one, out=one), v, out=spare[:z])
            v, spare = spare, v
        return cls(len(values), bits, zeros, planes)

    def all(self) -> np.ndarray:
        """Every symbol in order, from the lowest plane up: no random access, a few passes over each plane."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            z, up = int(self.zeros[k]), np.empty_like(v)
            up[~one] = v[:z]
            up[one] = v[z:] | v.dtype.type(1 << (self.bits - 1 - k))
            v = up
        return v

    def ones(self, k: int) -> np.ndarray:
        """Ones of plane k before each block of BLOCK bits; made from the plane when first asked for."""
        if self._ones[k] is None:
            per = np.bitwise_count(np.pad(self.planes[k], (0, -len(self.planes[k]) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            self._ones[k] = np.concatenate([[0], np.cumsum(per)])
        return self._ones[k]

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, p = i // BLOCK, self.planes[k]
        n = int(self.ones(k)[b]) + int(np.bitwise_count(p[b * BLOCK // 8 : i // 8]).sum())
        return n + (int(p[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) `bit` in plane k."""
        o = self.ones(k)
        c = o if bit else np.arange(len(o)) * BLOCK - o
        b = int(np.searchsorted(c, j, side="right")) - 1
        some = np.unpackbits(self.planes[k][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(some == bit)[j - int(c[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for k in range(self.bits):
            bit = self.planes[k][i // 8] >> i % 8 & 1
            r = self.rank1(k, i)
            i = int(self.zeros[k]) + r if bit else i - r
            v = v << 1 | int(bit)
        return v

    def ranks1(self, k: int, i: np.ndarray) -> np.ndarray:
        """`rank1` at many places of plane k: the block's count, whole bytes before, and the last byte's low bits."""
        p, byte = self.planes[k], i >> 3
        if not len(p):
            return np.zeros(len(i), np.int64)
        own = np.bitwise_count(np.append(p, np.uint8(0))[byte] & ((1 << (i & 7)) - 1).astype(np.uint8)).astype(np.int64)
        first = i // BLOCK * (BLOCK // 8)
        near = np.arange(BLOCK // 8)
        for lo in range(0, len(i), 4096):
            at = first[lo : lo + 4096, None] + near
            own[lo : lo + 4096] += np.where(at < byte[lo : lo + 4096, None], np.bitwise_count(p[np.minimum(at, len(p) - 1)]), 0).sum(1, dtype=np.int64)
        return own + self.ones(k)[i // BLOCK]

    def accesses(self, i: np.ndarray) -> np.ndarray:
        """The tokens at many places."""
        i, v = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit = (self.planes[k][i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(np.int64) if len(i) else i
            r = self.ranks1(k, i)
            i = np.where(bit == 1, int(self.zeros[k]) + r, i - r)
            v = v << 1 | bit
        return v

    def counts(self, token: int, places: np.ndarray) -> np.ndarray:
        """Occurrences of the token before each of many places."""
        lo, hi = 0, np.asarray(places, np.int64)
        for k in range(self.bits):
            one = token >> (self.bits - 1 - k) & 1
            a, b = self.rank1(k, lo), self.ranks1(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if one else (lo - a, hi - b)
        return hi - lo

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of the token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            i = self.select(k, one, i - int(self.zeros[k]) * one)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.occurrence(token, j) for j in range(self.count(token))]


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard file: header, then doc ids, document sizes, zeros per plane and the planes, each compressed by itself."""
    wm = WaveletMatrix.build(ids, bits)
    parts = [zlib.compress(x.tobytes(), 1) for x in (doc_ids.astype("<i8"), sizes.astype("<i8"), wm.zeros.astype("<i8"), *wm.planes)]
    body = struct.pack("<QII", wm.n, bits, len(doc_ids)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, document sizes, wavelet matrix) of a shard file; ValueError if it is damaged."""
    if data[:8] != MAGIC or struct.unpack_from("<I", data, 8)[0] != zlib.crc32(memoryview(data)[12:]):
        raise ValueError("not a whole shard file")
    n, bits, _ = struct.unpack_from("<QII", data, 12)
    lens = struct.unpack_from(f"<{bits + 3}Q", data, 28)
    at, parts = 28 + 8 * (bits + 3), []
    for k in lens:
        parts.append(zlib.decompress(memoryview(data)[at : at + k]))
        at += k
    docs, sizes, zeros = (np.frombuffer(x, "<i8") for x in parts[:3])
    return docs, sizes, WaveletMatrix(n, bits, zeros, [np.frombuffer(x, np.uint8) for x in parts[3:]])


def _classes(spaces: str, letters: str, digits: str) -> bytes:
    chars = map(chr, range(256))
    return bytes(0 if c in spaces else 1 if re.match(letters, c) else 2 if re.match(digits, c) else 3 for c in chars)


def _stand_ins() -> dict[int, str]:
    by = {b: c for c, b in _byte_alphabet().items()}
    return {i: "".join(by[b] for b in chr(i).encode()) for i in range(256)}


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, for a vocabulary whose pieces never reach across white
    space: the library encodes each distinct piece once and a cache repeats it. Pieces of lower-cased Latin-1 text are
    cut in vectors over blocks of many texts, numbered by Arrow's dictionary encoding and looked up once per distinct
    piece and block. Texts with characters outside Latin-1, or with added tokens or rare control characters, go to the
    library whole."""

    #: the pieces of a lower-cased Latin-1 word, as the vocabulary's pattern cuts them
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    ODD = re.compile("[\x1c-\x1f\x85]")
    SPACES = "\t\n\v\f\r \xa0"
    #: by Latin-1 character: 0 white space, 1 letter, 2 digit (each a piece of its own), 3 other
    CLASS = _classes(SPACES, "[a-zªµºß-öø-ÿ]", "[0-9²³¹¼-¾]")
    #: byte-level vocabularies write a character as one printable stand-in for each of its UTF-8 bytes
    STAND_IN = _stand_ins()
    BLOCK = 2 << 20

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.most = cache
        self.bits = max(1, (self.lib.get_vocab_size(True) - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(0, self.kind), np.zeros(1, np.int64)

    def plain(self, text: str) -> bool:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not self.ODD.search(text) and not any(a in text for a in self.added)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size
            ids, ends = self._plain_ids([r for _, r in held])
            for (i, _), a, b in zip(held, [0, *ends], ends):
                out[i] = ids[a:b]
            held, size = [], 0

        for i, t in enumerate(texts):
            if not self.plain(t):
                out[i] = np.array(self.lib.encode(t, add_special_tokens=False).ids, self.kind)
                continue
            raw = t.lower().encode("latin-1")
            if held and size + len(raw) > self.BLOCK:
                flush()
            held.append((i, raw))
            size += len(raw) + 1
        if held:
            flush()
        return out

    def _plain_ids(self, raws: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of some texts one after the other, and where each text's end."""
        if len(raws) == 1 and len(raws[0]) > 2 * self.BLOCK:  # a long text in blocks that end at white space
            raw, cls, at, parts = raws[0], raws[0].translate(self.CLASS), 0, []
            while at < len(raw):
                to = cls.find(b"\0", at + self.BLOCK)
                to = len(raw) if to < 0 else to
                parts.append(self._block(raw[at:to])[0])
                at = to
            ids = np.concatenate(parts)
            return ids, [len(ids)]
        ids, starts, at_piece = self._block(b" ".join(raws))
        last = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        return ids, at_piece[np.searchsorted(starts, last)].tolist()

    def _block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place in `raw` of each piece, ids before each piece and in all)."""
        import pyarrow as pa

        cls = np.frombuffer(raw.translate(self.CLASS), np.uint8)
        inside = cls != 0
        first = inside.copy()
        first[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        if b"'" in raw:  # contractions: the words that hold one are cut by the pattern
            text = raw.decode("latin-1")
            for word in re.finditer(f"[^{self.SPACES}]*'[^{self.SPACES}]*", text):
                first[word.start() : word.end()] = False
                first[[word.start() + m.start() for m in self.PIECE.finditer(word[0])]] = True
        starts = np.flatnonzero(first)
        body = np.frombuffer(raw, np.uint8)[inside]
        offsets = np.append(np.flatnonzero(first[inside]), len(body)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = number[pieces.indices.to_numpy()] if len(number) else number
        n = self.ends[which + 1] - self.ends[which]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.ends[which] - before[:-1], n) + np.arange(before[-1])]
        return ids, starts, before

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of distinct pieces in the cache; what it lacks goes to the library."""
        if len(self.number) > self.most:
            self._forget()
        found = list(map(self.number.get, pieces, repeat(-1)))
        number = np.array(found, np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            lack = [pieces[i] for i in new.tolist()]
            number[new] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(lack, number[new].tolist()))
            tokenize = self.lib.model.tokenize  # the library's model: pieces are normalised and cut already
            got = [[t.id for t in tokenize(p.decode("latin-1").translate(self.STAND_IN))] for p in lack]
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array(list(map(len, got)), np.int64))])
            self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(got)), self.kind)])
        return number


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def write_shards(df: DataFrame, path: str, end_id: int, uri: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes documents (doc_id, text) in ascending doc_id order into shard files below `uri`; returns the written
    manifest: part, shard (in order within the part), file, n_docs, n_tokens. Shards are named by part, task attempt
    and number and renamed into place when whole; of a task that runs twice, the manifest has one attempt's files."""

    def run(batches):
        from pyspark import TaskContext

        part, run_no, k = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        enc = loaded(path)
        tail = np.array([end_id], enc.kind)
        docs: list[int] = []
        texts: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal docs, texts, held, k
            sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
            file = f"{uri}/part-{part:06d}-{run_no:08d}-{k:06d}.wm"
            put_file(file, pack(np.array(docs, np.int64), sizes, np.concatenate([x for t in texts for x in (t, tail)]), enc.bits))
            row = (part, k, file, len(docs), held)
            docs, texts, held, k = [], [], 0, k + 1
            return row

        for b in batches:
            rows = []
            for d, x in zip(b.column(0).to_pylist(), enc.encode_all([t or "" for t in b.column(1).to_pylist()])):
                if docs and held + len(x) + 1 > shard_tokens:
                    rows.append(flush())
                docs.append(d)
                texts.append(x)
                held += len(x) + 1
            if rows:
                yield _batch(rows)
        if docs:
            yield _batch([flush()])

    def _batch(rows):
        import pyarrow as pa

        part, k, file, n, t = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(k, pa.int32()), pa.array(file, pa.string()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["part", "shard", "file", "n_docs", "n_tokens"])

    spark = df.sparkSession
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long"), "text").repartitionByRange(few, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(rows.mapInArrow(run, "part int, shard int, file string, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame, end_id: int | None = None) -> DataFrame:
    """One row per document from the shard files: doc_id, start, n_tokens, ids_crc32. A file is one row of the manifest,
    spread over the tasks by hash, and is read whole (a shard's size is bounded, save for a single longer document).
    With `end_id`, access must find it at each document's end (else the file is refused), and first_id (by access) and
    n_end_ids (by rank over the document's range) are added."""
    import pyarrow as pa
    from pyspark.sql import Window

    in_part = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = prefix_sums(parts, "part", "n", "base").select("part", "base")
    rows = (
        manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)))
        .join(starts, "part")
        .select("file", (F.col("before") + F.col("base")).cast("long").alias("start"))
        .repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    )

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs, sizes, wm = unpack(get_file(file))
                ends = np.cumsum(sizes)
                view = memoryview(wm.all().astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                cols = [pa.array(docs), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if end_id is not None:
                    if (wm.accesses(ends - 1) != end_id).any():
                        raise ValueError(f"{file}: a document doesn't end with {end_id}")
                    before = wm.counts(end_id, np.concatenate([[0], ends]))
                    cols += [pa.array(wm.accesses(ends - sizes)), pa.array(np.diff(before))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_end_ids"][: len(cols)])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", first_id long, n_end_ids long" * (end_id is not None))


def op4_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    uri = new_folder(spark, "shards")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, uri), 2)
