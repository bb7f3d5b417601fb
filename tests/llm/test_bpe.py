import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tsumugi.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = ["", " ", "  a", "a  b \n\n c", "it's we'll I'd 'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\0<|endoftext|>", "\0", "\x1c a\x1d", "日本語 текст ١٢٣ ½ Ⅷ", "🙂🙂 é", "a" * 5000, "ab" * 3000, "****" * 700, " " * 3000, "　x y z", "9" * 400]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def check(lib, texts):
    own = bpe.ByteBPE(PATH, cache_words=2000)
    for t, (ids, said), e in zip(texts, own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == e.ids, t[:80]
        assert said == ",".join(map(str, e.ids))
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False) == t
    return own


def test_edges_equal_library(lib):
    check(lib, EDGE)


def test_documents_equal_library_and_speculation_mostly_holds(lib):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    own = check(lib, texts)
    assert own.merged_words > 0


def test_every_code_point_class(lib):
    cps = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    check(lib, ["".join(f"a{chr(c)}1{chr(c)} " for c in cps[i : i + 500]) for i in range(0, len(cps), 500)])


def test_random_bytes_and_words(lib):
    rnd = random.Random(5)
    abc = "abcdeinrst '\n\t.,!ABé日́<|>endoftext"
    check(lib, ["".join(rnd.choice(abc) for _ in range(rnd.randint(0, 300))) for _ in range(400)])


def test_operator_nulls_ties_empty_and_clashing_columns(spark, lib):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello world", None), (3, "Hello world", None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "Hello world", "Hello world"]
    assert out[2].ids == lib.encode("Hello world", add_special_tokens=False).ids
    d = {r.doc_id: r for r in bpe.digests(df).collect()}
    assert d[1].n_tokens == 0 and d[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0
