"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from obsidia.llm.bit_sliced import OP2_SQL, op2_bit_sliced
from obsidia.llm.bpe import op5_byte_bpe
from obsidia.llm.embedding_dedup import op8_embedding_dedup
from obsidia.llm.minhash import op10_minhash
from obsidia.llm.packing import op1_packing
from obsidia.llm.quotation import OP3_SQL, op3_quotation
from obsidia.llm.substring_dedup import op9_substring_dedup
from obsidia.llm.suffix_dedup import op4_suffix_dedup
from obsidia.llm.toxicity import op6_toxicity
from obsidia.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_bit_sliced, op3_quotation, op4_suffix_dedup, op5_byte_bpe, op6_toxicity, op7_url_filter, op8_embedding_dedup, op9_substring_dedup, op10_minhash)
}
ORACLE_SQL = {"op2_bit_sliced": OP2_SQL, "op3_quotation": OP3_SQL, "op7_url_filter": OP7_SQL}
