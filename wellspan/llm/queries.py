"""The registered queries of this folder, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspan.llm import bpe, chat, jaccard_join, lang_id, mixing, packing, pii, quality, runs, secret_scan, toxicity, whitening, winnow
from wellspan.llm.common import table


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public.PATTERN).select("doc_id", "n_tokens", "ids")
    return bpe.decode(ids, path, public.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {
    "op1_language_id": lang_id.op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_winnow": winnow.op4_winnow,
    "op5_personal_data": pii.op5_personal_data,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_perspectives": chat.op8_perspectives,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_best_fit": packing.op10_best_fit,
    "op11_whitening": whitening.op11_whitening,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
SQL: dict[str, str] = {"op8_perspectives": chat.OP8_SQL, "op12_source_mix": mixing.OP12_SQL}
