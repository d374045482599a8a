"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, divergence, exact, licenses, mixing, ngram_join, packing, quality, resampling, secrets, sharding, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": sharding.op1_shard_documents,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_chat_format": chat.op3_chat_format,
    "op4_mix_documents": mixing.op4_mix_documents,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pack_documents": packing.op7_pack_documents,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_warc_packages": warc.op13_warc_packages,
}

SQL: dict[str, str] = {
    "op1_shard_documents": sharding.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op4_mix_documents": mixing.OP4_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_warc_packages": warc.OP13_SQL,
}
