"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytebpe import op10_byte_bpe
from .decontaminate import OP1_SQL, op1_decontaminate
from .exactdedup import OP6_SQL, op6_exact_dedup
from .hardnegatives import OP12_SQL, op12_hard_negatives
from .importance import OP11_SQL, op11_importance_resampling
from .licenses import LINES_SQL, OP2_SQL, license_lines, op2_license_scan
from .neardup import OP9_SQL, op9_near_duplicates
from .quality import op7_quality
from .qualityrules import OP13_SQL, op13_quality_rules
from .secrets import op3_secret_scan
from .tokencount import op4_token_counts
from .urlfilter import OP5_SQL, op5_url_filter
from .warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_license_scan, license_lines, op3_secret_scan, op4_token_counts, op5_url_filter, op6_exact_dedup, op7_quality, op8_warc, op9_near_duplicates, op10_byte_bpe, op11_importance_resampling, op12_hard_negatives, op13_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_license_scan": OP2_SQL, "license_lines": LINES_SQL, "op5_url_filter": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op8_warc": OP8_SQL, "op9_near_duplicates": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_quality_rules": OP13_SQL}
