"""The registered queries of this package and their SQL."""

import corpus_pipeline
from casewright.llm import chat, decontaminate, hard_negatives, near_dup, packing, quality, sharding, spelling, substrings, token_files, topk, toxicity, url_filter

QUERIES = {
    "op1_near_duplicates": near_dup.op1_near_duplicates,
    "op2_token_files": token_files.op2_token_files,
    "op3_substrings": substrings.op3_substrings,
    "op4_chat_perspectives": chat.op4_chat_perspectives,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_topk": topk.op7_topk,
    "op8_quality": quality.op8_quality,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op4_chat_perspectives": chat.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
