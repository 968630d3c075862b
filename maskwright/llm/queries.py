"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from maskwright.llm import chat_format, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, passage_dedup, phrase_mining, ppm_score, token_align, toxicity

QUERIES = {
    "op1_packing": packing.op1_query,
    "op2_language_id": language_id.op2_query,
    "op3_embedding_dedup": embedding_dedup.op3_query,
    "op4_html_extract": html_extract.op4_query,
    "op5_jaccard_join": jaccard_join.op5_query,
    "op6_line_dedup": line_dedup.op6_query,
    "op7_chat_format": chat_format.op7_query,
    "op8_decontaminate": decontaminate.op8_query,
    "op9_ppm_score": ppm_score.op9_query,
    "op10_toxicity": toxicity.op10_query,
    "op11_passage_dedup": passage_dedup.op11_query,
    "op12_phrase_mining": phrase_mining.op12_query,
    "op13_token_align": token_align.op13_query,
}

SQL = {
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op11_passage_dedup": passage_dedup.OP11_SQL,
    "op12_phrase_mining": phrase_mining.OP12_SQL,
}
