"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from terraloom.llm import bsi, contentmodel, divergence, forest, hilbert, kneserney, mixing, packing, sharding, suffixes, toxicity, warc, yinyang


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_ann": hilbert.op2_ann,
        "op3_packing": packing.op3_packing,
        "op4_topk": bsi.op4_topk,
        "op5_warc": warc.op5_warc,
        "op6_minhash": forest.op6_minhash,
        "op7_suffix": suffixes.op7_suffix,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lm": kneserney.op10_lm,
        "op11_divergence": divergence.op11_divergence,
        "op12_yinyang": yinyang.op12_yinyang,
        "op13_html": contentmodel.op13_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": bsi.OP4_SQL, "op5_warc": warc.OP5_SQL, "op6_minhash": forest.OP6_SQL, "op7_suffix": suffixes.OP7_SQL, "op8_mixing": mixing.OP8_SQL, "op11_divergence": divergence.OP11_SQL, "op12_yinyang": yinyang.OP12_SQL}
