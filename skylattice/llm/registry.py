"""Queries of this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from skylattice.llm.bloom_lm import op10_bloom_lm
from skylattice.llm.byte_bpe import op8_byte_bpe
from skylattice.llm.decontaminate import op5_decontaminate
from skylattice.llm.language import op7_language
from skylattice.llm.minhash import op9_minhash
from skylattice.llm.phrases import op1_phrases
from skylattice.llm.pivots import op4_pivots
from skylattice.llm.resample import OP12_SQL, op12_resample
from skylattice.llm.suffix_array import op6_suffix_array
from skylattice.llm.token_counts import op2_token_counts
from skylattice.llm.token_files import op13_token_files
from skylattice.llm.warc import OP3_SQL, op3_warc
from skylattice.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_phrases, op2_token_counts, op3_warc, op4_pivots, op5_decontaminate, op6_suffix_array, op7_language, op8_byte_bpe, op9_minhash, op10_bloom_lm, op11_whitening, op12_resample, op13_token_files)}

ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op12_resample": OP12_SQL}
