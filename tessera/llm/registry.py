"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from tessera.llm import align, ann, chat, decontaminate, minhash, mixing, pii, quality, substring, tokenbin, toxicity, tries, warc
from tessera.llm.common import ship, small_batches

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat": chat.op2_chat,
    "op3_warc": warc.op3_warc,
    "op4_substring": substring.op4_substring,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_minhash": minhash.op8_minhash,
    "op9_ann": ann.op9_ann,
    "op10_quality": quality.op10_quality,
    "op11_sources": tries.op11_sources,
    "op12_align": align.op12_align,
    "op13_tokenbin": tokenbin.op13_tokenbin,
    "pii_base": pii.pii_base,
}
ORACLE_SQL = {"op2_chat": chat.OP2_SQL, "op3_warc": warc.OP3_SQL, "op4_substring": substring.OP4_SQL, "op6_mixing": mixing.OP6_SQL, "op8_minhash": minhash.OP8_SQL, "op9_ann": ann.OP9_SQL, "op11_sources": tries.OP11_SQL, "pii_base": pii.PII_BASE_SQL}


def _ready(query):
    def run(spark, sf_dir):
        ship(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _ready(query) for name, query in QUERIES.items()}


def oracle_sql():
    return dict(ORACLE_SQL)
