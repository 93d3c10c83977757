"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op8_bpe
from .chat_prefix_tree import OP6_SQL, op6_chat_prefix_tree
from .decontamination import op3_decontamination
from .ngram_quality import op4_ngram_quality
from .packing import op13_packing
from .periodic_runs import op12_periodic_runs
from .quality_classifier import op7_quality
from .secrets import op2_secrets
from .sharding import op10_sharding
from .simhash import op1_simhash
from .substring_dedup import op5_substring_dedup
from .tokenizer_alignment import op11_alignment
from .toxicity import op9_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_secrets, op3_decontamination, op4_ngram_quality, op5_substring_dedup, op6_chat_prefix_tree, op7_quality, op8_bpe, op9_toxicity, op10_sharding, op11_alignment, op12_periodic_runs, op13_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_prefix_tree": OP6_SQL}
