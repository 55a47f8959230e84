"""The numbered queries, with SQL where SQL can state them."""

from __future__ import annotations

from . import decontaminate, extract, jaccard, middle, mixing, nearest, packing, periodic, pseudonyms, quality, sharding, token_counts, warc


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_warc": warc.op2_warc,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_token_ids": packing.op4_token_ids,
        "op6_html_extraction": extract.op6_html_extraction,
        "op7_ring_shards": sharding.op7_ring_shards,
        "op8_pseudonyms": pseudonyms.op8_pseudonyms,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op5_quality_rules": quality.op5_quality_rules,
        "op11_exact_top_k": nearest.op11_exact_top_k,
        "op12_fill_in_middle": middle.op12_fill_in_middle,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_decontamination": decontaminate.ORACLE_SQL,
        "op9_jaccard_join": jaccard.ORACLE_SQL,
        "op10_mix_sources": mixing.ORACLE_SQL,
        "op11_exact_top_k": nearest.ORACLE_SQL,
        "op12_fill_in_middle": middle.ORACLE_SQL,
        "op13_periodic_runs": periodic.ORACLE_SQL,
    }
