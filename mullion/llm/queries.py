"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mullion.llm.byte_bpe import op9_byte_bpe
from mullion.llm.chat_format import op4_chat_format
from mullion.llm.decontaminate import OP5_SQL, op5_decontaminate
from mullion.llm.license_scan import op7_license_scan
from mullion.llm.line_dedup import OP11_SQL, op11_line_dedup
from mullion.llm.ngram_join import OP1_SQL, op1_ngram_join
from mullion.llm.pii import op3_pii
from mullion.llm.quality_rules import OP6_SQL, op6_quality_rules
from mullion.llm.run_detect import OP13_SQL, op13_run_detect
from mullion.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from mullion.llm.url_filters import OP10_SQL, op10_url_filters
from mullion.llm.vector_codes import OP12_SQL, op12_vector_codes
from mullion.llm.warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_warc": op2_warc,
        "op3_pii": op3_pii,
        "op4_chat_format": op4_chat_format,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality_rules": op6_quality_rules,
        "op7_license_scan": op7_license_scan,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_url_filters": op10_url_filters,
        "op11_line_dedup": op11_line_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_run_detect": op13_run_detect,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL,
        "op2_warc": OP2_SQL,
        "op5_decontaminate": OP5_SQL,
        "op6_quality_rules": OP6_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op10_url_filters": OP10_SQL,
        "op11_line_dedup": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_run_detect": OP13_SQL,
    }
