"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quillon.llm.bpe import op13_bpe
from quillon.llm.decontaminate import op7_decontamination
from quillon.llm.fingerprint import op10_fingerprint
from quillon.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from quillon.llm.html_text import op5_html_text
from quillon.llm.lexical import OP12_SQL, op12_lexical_search
from quillon.llm.mixing import OP3_SQL, op3_mixing
from quillon.llm.near_dedup import op6_near_dedup
from quillon.llm.pii import op9_pii
from quillon.llm.quality import op2_quality
from quillon.llm.substring_dedup import op8_substring_dedup
from quillon.llm.toxicity import op4_toxicity
from quillon.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_near_dedup": op6_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_pii": op9_pii,
    "op10_fingerprint": op10_fingerprint,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_bpe": op13_bpe,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op3_mixing": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_lexical_search": OP12_SQL}
