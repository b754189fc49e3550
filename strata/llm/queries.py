"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from strata.llm.bpe import op8_byte_bpe
from strata.llm.dartminhash import OP2_SQL, op2_near_duplicates
from strata.llm.decontaminate import op7_decontamination
from strata.llm.langid import op9_language_id
from strata.llm.licenses import op5_license_scan
from strata.llm.linededup import OP6_SQL, op6_line_dedup
from strata.llm.ngramlm import op10_lm_score
from strata.llm.quality import op1_quality
from strata.llm.tokenfile import op3_token_file
from strata.llm.topk import OP4_SQL, op4_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_file": op3_token_file,
    "op4_top_k": op4_top_k,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_lm_score": op10_lm_score,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_near_duplicates": OP2_SQL, "op4_top_k": OP4_SQL, "op6_line_dedup": OP6_SQL}
