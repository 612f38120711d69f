"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placewise.llm import ann, dedup, html, langid, lm, media, mixing, packing, quality, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_nearest": ann.op2_nearest,
        "op3_quality": quality.op3_quality,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_main_text": html.op5_main_text,
        "op6_media": media.op6_media,
        "op7_mixing": mixing.op7_mixing,
        "op8_near_dedup": dedup.op8_near_dedup,
        "op9_packing": packing.op9_packing,
        "op10_lm_score": lm.op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.OP4_SQL, "op8_near_dedup": dedup.OP8_SQL}
