"""Queries of the corpus operators and, where SQL can express them, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offermill.llm.audio import op4_audio_alignment
from offermill.llm.context_tree import op9_context_tree
from offermill.llm.divergence import SQL as OP13_SQL
from offermill.llm.divergence import op13_source_divergence
from offermill.llm.fingerprints import op8_fingerprints
from offermill.llm.near_dedup import op6_near_dedup
from offermill.llm.negatives import SQL as OP12_SQL
from offermill.llm.negatives import op12_hard_negatives
from offermill.llm.packing import op7_best_fit_packing
from offermill.llm.quality import op5_quality_classifier
from offermill.llm.secrets import op3_secret_scan
from offermill.llm.sentencepieces import op2_sentencepiece_n_best
from offermill.llm.sharding import op11_sharding
from offermill.llm.token_counts import op10_token_counts
from offermill.llm.toxicity import op1_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sentencepiece_n_best": op2_sentencepiece_n_best,
        "op3_secret_scan": op3_secret_scan,
        "op4_audio_alignment": op4_audio_alignment,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_near_dedup": op6_near_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_fingerprints": op8_fingerprints,
        "op9_context_tree": op9_context_tree,
        "op10_token_counts": op10_token_counts,
        "op11_sharding": op11_sharding,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": OP12_SQL, "op13_source_divergence": OP13_SQL}
