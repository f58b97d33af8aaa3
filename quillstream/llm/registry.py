"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from quillstream.llm import (
    conversation_repair, exact_dedup, fingerprints, html_extraction, importance, language_id, lm_scoring, mixing, ngram_join, packing, pieces, quality, sharding,
)

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_packing": packing.op5_packing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_quality": quality.op9_quality,
    "op10_language_id": language_id.op10_language_id,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_importance": importance.op12_importance,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op12_importance": importance.OP12_SQL, "op13_conversation_repair": conversation_repair.OP13_SQL}
