import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tsumugi.llm import wavelet
from tsumugi.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 512, 3000])
def test_matrix_equals_array(n):
    v = np.random.default_rng(n).integers(0, 60, n)
    wm = wavelet.unpack(wavelet.pack(np.arange(1), np.array([n]), v, 6))[2]
    assert wm.all().tolist() == v.tolist()
    assert [wm.access(i) for i in range(0, n, 17)] == v[::17].tolist()
    for t in (0, 5, 59):
        assert wm.occurrences(t) == np.flatnonzero(v == t).tolist()
        assert wm.count(t, n // 3, n // 2) == int((v[n // 3 : n // 2] == t).sum())
        assert wm.counts(t, np.arange(n + 1)).tolist() == [int((v[:i] == t).sum()) for i in range(n + 1)]
    assert wm.accesses(np.arange(n)).tolist() == v.tolist()
    with pytest.raises(IndexError):
        wm.access(n)
    with pytest.raises(IndexError):
        wm.occurrence(61, 0)


def test_damaged_file_is_refused():
    data = bytearray(wavelet.pack(np.arange(1), np.array([3]), np.array([1, 2, 3]), 4))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        wavelet.unpack(bytes(data))


def test_ids_equal_library():
    lib, own = Tokenizer.from_file(PATH), wavelet.WordIds(PATH, cache=500)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += ["", " ", "It's we'll'S''ll", "<|endoftext|>a", "x<|startoftext|>", "ÀÉß \x85\xa0 µªº²½", "\x1ca\x1fb", "ΑΣ ΟΔΟΣ", "日本語ー", "é", "İ", "a b", "!" * 3000, "ab1 2c" * 900]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:60]


def test_blocks_and_batches_equal_library():
    lib, own = Tokenizer.from_file(PATH), wavelet.WordIds(PATH)
    own.BLOCK = 700
    long = " ".join(["it's", "l'été", "x" * 40, "3.14", "we'll'S!!'s"] * 90)
    texts = [long, "a", "", "日本", long[:333], "'", "''s 't", " ", long + "\n", "y" * 3000, "end"]
    got = own.encode_all(texts)
    assert [g.tolist() for g in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_lookups_by_access_and_rank(spark):
    rows = [(i, "# a # b" * (i % 3)) for i in range(50)]
    got = wavelet.read_shards(wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2, new_folder(spark, "t"), shard_tokens=30), 2).collect()
    lib = Tokenizer.from_file(PATH)
    for r in got:
        ids = [*lib.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 2]
        assert (r.first_id, r.n_end_ids) == (ids[0], ids.count(2))


def test_write_and_read_back(spark):
    rows = [(i * 7 % 101, None if i % 9 == 0 else "" if i % 11 == 0 else f"Word {i} three's " * (i % 5), "x") for i in range(101)] + [(200, "same", "x"), (200, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = wavelet.read_shards(wavelet.write_shards(df, PATH, 2, new_folder(spark, "t"), shard_tokens=40)).collect()
    lib, at, want = Tokenizer.from_file(PATH), 0, []
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    assert wavelet.read_shards(wavelet.write_shards(df.limit(0), PATH, 2, new_folder(spark, "t"))).count() == 0
