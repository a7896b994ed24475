"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from tracefold.llm.ann import op6_ann
from tracefold.llm.chat_format import op8_chat_format
from tracefold.llm.decontaminate import op1_decontaminate
from tracefold.llm.lang_id import op3_language_id
from tracefold.llm.lm_score import op7_lm_score
from tracefold.llm.near_dedup import op5_near_dedup
from tracefold.llm.packing import op4_best_fit_packing
from tracefold.llm.secret_scan import op9_secret_scan
from tracefold.llm.toxicity import op10_toxicity
from tracefold.llm.warc import OP2_SQL, op2_warc_zstd

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_warc_zstd, op3_language_id, op4_best_fit_packing, op5_near_dedup, op6_ann, op7_lm_score, op8_chat_format, op9_secret_scan, op10_toxicity)}
ORACLE_SQL = {"op2_warc_zstd": OP2_SQL}
