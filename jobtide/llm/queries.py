"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .chat import OP6_SQL, op6_chat_formatting
from .decontaminate import OP3_SQL, op3_decontamination
from .katz import OP11_SQL, op11_katz_backoff
from .language import op8_word_backoff_language
from .neardup import op7_minhash_neardup
from .packing import op2_sum_of_squares_packing
from .pii import op9_weak_supervision_pii
from .repetition import op4_quality_rules
from .resampling import op1_importance_resampling
from .spelling import op13_pivotal_spelling_variants
from .textkit import scratch, written
from .toxicity import op5_bigru_toxicity
from .urls import OP10_SQL, op10_url_filter
from .vectors import OP12_SQL, op12_bitmask_product_codes



def tidy(query: Callable) -> Callable:
    """The query with its result written, so that the tables it made on the way are deleted."""

    def run(spark, sf_dir: str) -> DataFrame:
        with scratch(spark) as kept:
            out = written(query(spark, sf_dir), query.__name__)
            kept.append(out)
        return out

    return run


QUERIES: dict[str, Callable] = {
    "op1_importance_resampling": tidy(op1_importance_resampling),
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_decontamination": tidy(op3_decontamination),
    "op4_quality_rules": op4_quality_rules,
    "op5_bigru_toxicity": op5_bigru_toxicity,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_word_backoff_language": op8_word_backoff_language,
    "op9_weak_supervision_pii": tidy(op9_weak_supervision_pii),
    "op10_url_filter": tidy(op10_url_filter),
    "op11_katz_backoff": op11_katz_backoff,
    "op12_bitmask_product_codes": tidy(op12_bitmask_product_codes),
    "op13_pivotal_spelling_variants": op13_pivotal_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_katz_backoff": OP11_SQL,
    "op12_bitmask_product_codes": OP12_SQL,
}
