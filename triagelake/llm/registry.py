"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .blocks import op3_block_labeller
from .bpe import op12_pair_index
from .contamination import OP4_SQL, op4_spaced_seeds
from .filter_audit import OP13_SQL, op13_filter_audit
from .hmm import op10_hidden_markov
from .longmatch import op7_suffix_family
from .media import op1_png_media
from .packing import op8_best_fit
from .quality import op5_pairwise_quality
from .simhash import op2_simhash_balls
from .slots import op6_virtual_slots
from .toxicity import op9_kneser_ney_toxicity
from .variants import op11_full_neighbourhood


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_png_media, op2_simhash_balls, op3_block_labeller, op4_spaced_seeds, op5_pairwise_quality, op6_virtual_slots, op7_suffix_family, op8_best_fit, op9_kneser_ney_toxicity, op10_hidden_markov, op11_full_neighbourhood, op12_pair_index, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op4_spaced_seeds": OP4_SQL, "op13_filter_audit": OP13_SQL}
