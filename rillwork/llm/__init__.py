"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .op1_quality import op1_line_frequency
from .op2_packing import op2_best_fit
from .op3_html import op3_suffix_text
from .op4_surrogates import op4_keyed_surrogates
from .op5_decontaminate import op5_prefix_join
from .op6_codes import op6_addressable_codes
from .op7_simhash import op7_simhash_bktree
from .op8_counts import op8_token_counts
from .op9_chat import op9_chat_windows
from .op10_lines import op10_fuzzy_lines
from .op11_audit import op11_subset_zeta
from .op12_variants import op12_trie_variants
from .op13_pretokens import op13_word_shuffle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_line_frequency, op2_best_fit, op3_suffix_text, op4_keyed_surrogates, op5_prefix_join, op6_addressable_codes,
        op7_simhash_bktree, op8_token_counts, op9_chat_windows, op10_fuzzy_lines, op11_subset_zeta, op12_trie_variants,
        op13_word_shuffle,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
