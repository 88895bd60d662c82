"""The subpackage's registered queries, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusql.llm.bpe import op13_bpe_round_trip
from corpusql.llm.decontaminate import op10_decontamination
from corpusql.llm.divergence import OP12_SQL, op12_source_divergence
from corpusql.llm.merkle import OP11_SQL, op11_merkle_manifest
from corpusql.llm.packing import op7_bestfit_packing
from corpusql.llm.pii import op1_personal_data
from corpusql.llm.repetition import op3_quality_repetition
from corpusql.llm.secrets import op5_secret_scan
from corpusql.llm.setjoin import op2_ngram_jaccard
from corpusql.llm.sharding import op6_jump_sharding
from corpusql.llm.suffixdedup import op8_suffix_dedup
from corpusql.llm.toxicity import op4_toxicity
from corpusql.llm.warc import OP9_SQL, op9_warc_roundtrip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_personal_data, op2_ngram_jaccard, op3_quality_repetition, op4_toxicity, op5_secret_scan, op6_jump_sharding, op7_bestfit_packing, op8_suffix_dedup, op9_warc_roundtrip, op10_decontamination, op11_merkle_manifest, op12_source_divergence, op13_bpe_round_trip]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc_roundtrip": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_source_divergence": OP12_SQL}
