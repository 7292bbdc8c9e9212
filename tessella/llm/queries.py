"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tessella.llm import decontaminate, language, main_text, mixing, near_dup, pii, quality, token_file, topk
from tessella.llm.sharding import op1_sharding

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_ngram_jaccard": near_dup.op4_ngram_jaccard,
    "op5_pii": pii.op5_pii,
    "op6_token_file": token_file.op6_token_file,
    "op7_mixing": mixing.op7_mixing,
    "op8_main_text": main_text.op8_main_text,
    "op9_topk": topk.op9_topk,
    "op10_language": language.op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_ngram_jaccard": near_dup.ORACLE,
    "op9_topk": topk.ORACLE,
}
