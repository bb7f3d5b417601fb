"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, gif, mixing, ordinal, rules, simhash, spans, suffix, warc, wavelet


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_warc": warc.op2_warc,
        "op3_gif": gif.op3_gif,
        "op4_wavelet": wavelet.op4_wavelet,
        "op5_mix": mixing.op5_mix,
        "op6_spans": spans.op6_spans,
        "op7_simhash": simhash.op7_simhash,
        "op8_rules": rules.op8_rules,
        "op9_suffix": suffix.op9_suffix,
        "op10_ordinal": ordinal.op10_ordinal,
        "gif_frames": gif.gif_frames,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.OP2_SQL, "op5_mix": mixing.OP5_SQL}
