"""The training-data queries and, where SQL can say what they return, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op10_nearest_neighbours
from .divergence import ORACLE as OP12_SQL
from .divergence import op12_source_divergence
from .langid import op9_language_id
from .middle import ORACLE as OP11_SQL
from .middle import op11_fill_in_middle
from .ngramjoin import op13_ngram_jaccard
from .packing import op2_best_fit_packing
from .quality import op6_quality_classifier
from .sentencepiece_fst import op8_sentencepiece
from .sharding import op5_sharding
from .simhash import op7_simhash_near_dedup
from .tokenfile import op4_token_binary
from .topk import ORACLE as OP1_SQL
from .topk import op1_exact_topk
from .urls import ORACLE as OP3_SQL
from .urls import op3_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_url_filters": op3_url_filters,
        "op4_token_binary": op4_token_binary,
        "op5_sharding": op5_sharding,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_language_id": op9_language_id,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_source_divergence": op12_source_divergence,
        "op13_ngram_jaccard": op13_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_url_filters": OP3_SQL, "op11_fill_in_middle": OP11_SQL, "op12_source_divergence": OP12_SQL}
