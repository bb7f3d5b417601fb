import hashlib

import corpus_pipeline as cp
from tokenizers import Tokenizer

from tsumugi.llm import bpe
from tsumugi.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = table(spark, SF, "documents")
    cols, kept = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns == cols, name
    n = [d.count() for d in kept]
    assert n[0] > n[1] > n[2] == n[3]
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3]
    before = {r.doc_id: r.text for r in kept[2].collect()}
    assert all(r.n_chars == len(r.text) <= len(before[r.doc_id]) for r in kept[3].collect())
    lib = Tokenizer.from_file(bpe.default_path())
    last = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in cp.STAGES[-1][1](spark, kept[4], SF).collect())
    want = []
    for r in kept[4].collect():
        e = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()))
    assert last == sorted(want)
