"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import oracle
from .bpe import op3_byte_bpe
from .chat import op10_chat_format
from .decontaminate import op1_decontaminate
from .language_model import op2_lm_score
from .near_dedup import op5_near_dedup
from .quality import op8_quality_rules
from .repeats import op9_suffix_dedup
from .token_counts import op7_token_counts
from .toxicity import op6_toxicity
from .url_filter import op4_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_score": op2_lm_score,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_format": op10_chat_format,
}

#: The others need a tokenizer library, a fitted model or a random sampler; tests/llm holds them against brute force,
#: the libraries or held-out rows.
ORACLE: dict[str, str] = {
    "op1_decontaminate": oracle.DECONTAMINATE,
    "op5_near_dedup": oracle.NEAR_DEDUP,
    "op9_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op10_chat_format": oracle.CHAT_FORMAT,
}
