"""The opN_ queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation import op13_conversations
from .decontaminate import op3_decontamination
from .huffman import op7_token_files
from .imatch import op5_imatch
from .language import op6_language
from .lines import op2_lines
from .pieces import op8_pieces
from .pii import op4_pii
from .quality import op9_quality
from .simhash import op1_simhash
from .toxicity import op12_toxicity
from .warc import op10_warc
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_lines": op2_lines,
        "op3_decontamination": op3_decontamination,
        "op4_pii": op4_pii,
        "op5_imatch": op5_imatch,
        "op6_language": op6_language,
        "op7_token_files": op7_token_files,
        "op8_pieces": op8_pieces,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
        "op11_whitening": op11_whitening,
        "op12_toxicity": op12_toxicity,
        "op13_conversations": op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {}
