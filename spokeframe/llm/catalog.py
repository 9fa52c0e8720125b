"""The queries of this subpackage, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from .alignment import op13_alignment
from .bpe import op5_byte_bpe
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .languages import op4_language
from .lm_scoring import op11_lm_scoring
from .near_dedup import op3_near_dedup
from .nearest import OP9_SQL, op9_kd_top_k
from .packing import op10_best_fit_packing
from .suffix_dedup import op6_suffix_dedup
from .token_files import op2_token_files
from .toxicity import op8_toxicity
from .url_rules import op7_url_rules
from .whitening import op12_whitening

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_files": op2_token_files,
    "op3_near_dedup": op3_near_dedup,
    "op4_language": op4_language,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_rules": op7_url_rules,
    "op8_toxicity": op8_toxicity,
    "op9_kd_top_k": op9_kd_top_k,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op9_kd_top_k": OP9_SQL}
