"""Operators for preparing training corpora. Nothing else in the library imports this subpackage."""

from quillscan.llm import bloom_lm, conversation_trie, decontamination, exact_dedup, fingerprints, language_id, lexical_index, mixing, near_dedup, packing, substring_dedup, token_blocks, toxicity

QUERIES = {
    "op1_token_blocks": token_blocks.query,
    "op2_fingerprints": fingerprints.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_mix_sources": mixing.query,
    "op6_bloom_lm": bloom_lm.query,
    "op7_near_dedup": near_dedup.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_pack_sequences": packing.query,
    "op10_language": language_id.query,
    "op11_lexical_search": lexical_index.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_decontaminate": decontamination.query,
}

ORACLE_SQL = {
    "op5_mix_sources": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_lexical_search": lexical_index.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
    "op13_decontaminate": decontamination.ORACLE,
}
