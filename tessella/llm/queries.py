"""The queries opN_<name> of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.chat_format import OP2_SQL, op2_perspective_rotation
from tessella.llm.near_duplicates import OP10_SQL, op10_minhash_hamming_join
from tessella.llm.ngram_perplexity import op1_ngram_perplexity
from tessella.llm.packing import op8_linear_grouping_packing
from tessella.llm.secret_scan import op3_zstd_novelty_secrets
from tessella.llm.token_store import op6_rans_token_files
from tessella.llm.toxicity import op9_class_kneser_ney
from tessella.llm.viterbi_tokens import op5_batched_viterbi
from tessella.llm.warc import OP7_SQL, op7_seekable_warc
from tessella.llm.winnowing import op4_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_ngram_perplexity, op2_perspective_rotation, op3_zstd_novelty_secrets, op4_winnowing, op5_batched_viterbi,
        op6_rans_token_files, op7_seekable_warc, op8_linear_grouping_packing, op9_class_kneser_ney, op10_minhash_hamming_join,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_perspective_rotation": OP2_SQL, "op7_seekable_warc": OP7_SQL, "op10_minhash_hamming_join": OP10_SQL}
