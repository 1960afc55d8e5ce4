"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import host_rules, ngram_join, url_filter
from .ann import op10_nearest_neighbours
from .host_rules import op7_host_rules
from .language import op4_language
from .line_dedup import op3_line_dedup
from .mixing import op9_mixing
from .ngram_join import op2_ngram_jaccard
from .packing import op8_best_fit_packing
from .quality import op1_importance_resampling
from .token_counts import op6_token_counts
from .url_filter import op5_url_filter

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_language": op4_language,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_host_rules": op7_host_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mixing": op9_mixing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": ngram_join.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op7_host_rules": host_rules.ORACLE,
}
