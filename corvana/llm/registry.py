"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import bpe, licenses, neardup, packing, pages, quality, rules, suffixes, topk, toxicity, tries, variants, vectors


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_bpe": bpe.op2,
        "op3_packing": packing.op3,
        "op4_minhash": neardup.op4,
        "op5_quality_rules": rules.op5,
        "op6_topk": topk.op6,
        "op7_quality": quality.op7,
        "op8_suffixes": suffixes.op8,
        "op9_licenses": licenses.op9,
        "op10_pages": pages.op10,
        "op11_vectors": vectors.op11,
        "op12_tries": tries.op12,
        "op13_variants": variants.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": rules.SQL, "op6_topk": topk.SQL, "op11_vectors": vectors.SQL}
