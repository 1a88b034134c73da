"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversations, decontaminate, embedding_dedup, minhash_dedup, ngram_lm, packing, phrases, piece_codec, quality, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_minhash": minhash_dedup.op4_minhash,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_warc": warc.op8_warc,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_lm_scoring": ngram_lm.op10_lm_scoring,
    "op11_conversations": conversations.op11_conversations,
    "op12_pieces": piece_codec.op12_pieces,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op4_minhash": minhash_dedup.ORACLE_SQL,
    "op5_url_filters": url_filter.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op11_conversations": conversations.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
