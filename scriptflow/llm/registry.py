"""The queries of the subpackage, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    collocations,
    decontamination,
    exact,
    jaccard,
    licenses,
    lines,
    packing,
    pii,
    ppm,
    quality,
    repeats,
    turns,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_lines": lines.op2_lines,
        "op3_quality": quality.op3_quality,
        "op4_ppm": ppm.op4_ppm,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_pii": pii.op6_pii,
        "op7_repeats": repeats.op7_repeats,
        "op8_exact": exact.op8_exact,
        "op9_packing": packing.op9_packing,
        "op10_chat": chat.op10_chat,
        "op11_collocations": collocations.op11_collocations,
        "op12_turns": turns.op12_turns,
        "op13_licenses": licenses.op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lines": lines.OP2_SQL,
        "op5_jaccard": jaccard.OP5_SQL,
        "op7_repeats": repeats.OP7_SQL,
        "op8_exact": exact.OP8_SQL,
        "op10_chat": chat.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_turns": turns.OP12_SQL,
    }
