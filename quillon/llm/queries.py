"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, langid, linededup, media, mixing, neardup, quality, secrets, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_secrets": secrets.op3_secrets,
        "op4_mixing": mixing.op4_mixing,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_html": extract.op7_html,
        "op8_tiff": media.op8_tiff,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_language": langid.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op5_near_duplicates": neardup.OP5_SQL,
    }
