"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomwork.llm.bytebpe import op13_byte_bpe
from loomwork.llm.decontamination import OP7_SQL, op7_decontamination
from loomwork.llm.language import op5_language
from loomwork.llm.media import op2_media
from loomwork.llm.mixing import OP3_SQL, op3_mixed_sources
from loomwork.llm.neardup import OP8_SQL, op8_near_duplicates
from loomwork.llm.packing import op10_packed_ids
from loomwork.llm.pii import op6_pseudonyms
from loomwork.llm.prefixtrie import OP11_SQL, op11_prefix_trie
from loomwork.llm.quality import op9_quality
from loomwork.llm.substrings import OP4_SQL, op4_substring_dedup
from loomwork.llm.toxicity import op1_toxicity
from loomwork.llm.vectorcodes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_mixed_sources": op3_mixed_sources,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language": op5_language,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_packed_ids": op10_packed_ids,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES = {"op3_mixed_sources": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op7_decontamination": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_vector_codes": OP12_SQL}
