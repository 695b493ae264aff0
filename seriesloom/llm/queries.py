"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from seriesloom.llm import chat, decontam, fim, langid, lexical, mixing, pii, quality, repeats, sharding, simhash, topk, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_warc_boundary_chain": warc.op2_warc_boundary_chain,
        "op3_pu_quality": quality.op3_pu_quality,
        "op4_surrogate_pii": pii.op4_surrogate_pii,
        "op5_rank_order_language": langid.op5_rank_order_language,
        "op6_schema_fingerprint_chat": chat.op6_schema_fingerprint_chat,
        "op7_kd_tree_sharding": sharding.op7_kd_tree_sharding,
        "op8_spaced_seed_decontamination": decontam.op8_spaced_seed_decontamination,
        "op9_block_at_a_time_top_k": topk.op9_block_at_a_time_top_k,
        "op10_capped_water_filling": mixing.op10_capped_water_filling,
        "op11_seed_and_extend_repeats": repeats.op11_seed_and_extend_repeats,
        "op12_sparse_index_fim": fim.op12_sparse_index_fim,
        "op13_range_maximum_search": lexical.op13_range_maximum_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_boundary_chain": warc.OP2_SQL,
        "op6_schema_fingerprint_chat": chat.OP6_SQL,
        "op8_spaced_seed_decontamination": decontam.OP8_SQL,
        "op9_block_at_a_time_top_k": topk.OP9_SQL,
        "op10_capped_water_filling": mixing.OP10_SQL,
        "op11_seed_and_extend_repeats": repeats.OP11_SQL,
        "op12_sparse_index_fim": fim.OP12_SQL,
        "op13_range_maximum_search": lexical.OP13_SQL,
    }
