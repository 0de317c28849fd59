"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from factloom.llm import q_class_lm, q_collocation, q_decontam, q_hard_negatives, q_jaccard, q_langid, q_licences, q_mixing, q_quality, q_suffix, q_token_count, q_token_file, q_topk

QUERIES = {
    "op1_decontam": q_decontam.op1_decontam,
    "op2_token_file": q_token_file.op2_token_file,
    "op3_token_count": q_token_count.op3_token_count,
    "op4_suffix": q_suffix.op4_suffix,
    "op5_mixing": q_mixing.op5_mixing,
    "op6_class_lm": q_class_lm.op6_class_lm,
    "op7_jaccard": q_jaccard.op7_jaccard,
    "op8_topk": q_topk.op8_topk,
    "op9_quality": q_quality.op9_quality,
    "op10_langid": q_langid.op10_langid,
    "op11_licences": q_licences.op11_licences,
    "op12_collocation": q_collocation.op12_collocation,
    "op13_hard_negatives": q_hard_negatives.op13_hard_negatives,
}
SQL = {"op1_decontam": q_decontam.OP1_SQL, "op7_jaccard": q_jaccard.OP7_SQL, "op8_topk": q_topk.OP8_SQL, "op12_collocation": q_collocation.OP12_SQL, "op13_hard_negatives": q_hard_negatives.OP13_SQL}
