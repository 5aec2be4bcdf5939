"""The numbered queries and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_text import op3_main_text
from .jaccard_join import op8_jaccard_join
from .lattice_lm import op5_lattice_lm
from .lexical_search import OP11_SQL, op11_lexical_search
from .license_scan import op12_license_scan
from .mixing import op6_mixing_rates
from .packing import op2_best_fit_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_bands import op1_quality_bands
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op10_token_counts
from .topk import OP7_SQL, op7_exact_top_k

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_bands, op2_best_fit_packing, op3_main_text, op4_substring_dedup, op5_lattice_lm, op6_mixing_rates, op7_exact_top_k, op8_jaccard_join, op9_suffix_dedup, op10_token_counts, op11_lexical_search, op12_license_scan, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_top_k": OP7_SQL, "op11_lexical_search": OP11_SQL, "op13_prefix_trie": OP13_SQL}
