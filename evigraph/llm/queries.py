"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from evigraph.llm import block_max, bpe, chat, fill_middle, host_rules, langid, matroska, near_dup, packing, repeats, secrets, warc, yinyang


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_chat_prefix_targets": chat.query,
        "op2_language_centroids": langid.query,
        "op3_warc_index": warc.query,
        "op4_bpe_round_trip": bpe.query,
        "op5_matroska_packets": matroska.query,
        "op6_secret_scan": secrets.query,
        "op7_bounded_packing": packing.query,
        "op8_host_rules": host_rules.query,
        "op9_near_duplicates": near_dup.query,
        "op10_repeated_bytes": repeats.query,
        "op11_fill_middle": fill_middle.query,
        "op12_yinyang_clusters": yinyang.query,
        "op13_block_max_search": block_max.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_prefix_targets": chat.SQL,
        "op3_warc_index": warc.SQL,
        "op8_host_rules": host_rules.SQL,
        "op9_near_duplicates": near_dup.SQL,
        "op11_fill_middle": fill_middle.SQL,
        "op12_yinyang_clusters": yinyang.SQL,
        "op13_block_max_search": block_max.SQL,
    }
