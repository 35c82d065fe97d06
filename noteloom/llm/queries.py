"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from noteloom.llm.bpe import op1_bpe
from noteloom.llm.embed_dedup import OP11_SQL, op11_embed_dedup
from noteloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from noteloom.llm.fingerprint import op7_fingerprint
from noteloom.llm.mixing import op8_mixing
from noteloom.llm.near_dedup import op5_near_dedup
from noteloom.llm.sharding import op3_sharding
from noteloom.llm.spelling import op13_spelling
from noteloom.llm.suffix_dedup import op4_suffix_dedup
from noteloom.llm.suffix_tree import op2_lm_score
from noteloom.llm.token_alignment import op12_token_alignment
from noteloom.llm.toxicity import op9_toxicity
from noteloom.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm_score": op2_lm_score,
    "op3_sharding": op3_sharding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fingerprint": op7_fingerprint,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_embed_dedup": op11_embed_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op10_warc": OP10_SQL,
    "op11_embed_dedup": OP11_SQL,
}
