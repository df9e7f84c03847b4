"""From documents to packed training sequences: five stages, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of their input. Documents without a recognisable language and toxic ones go, one
of each group of near copies stays, secrets are masked in the texts, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wellspan.llm import jaccard_join, lang_id, packing, secret_scan, toxicity
from wellspan.llm.common import fold, free_name, table
from wellspan.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = lang_id.fit(docs.select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    return lang_id.keep(docs, model)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 5)
    labels = table(spark, sf_dir, "labels").where(part != 0).select("doc_id", "toxic")
    return toxicity.keep(docs, toxicity.fit(docs.where(part != 0).select("doc_id", "text"), labels))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = secret_scan.read_dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    masked = secret_scan.find(docs, words, out=free_name(docs, "secrets"), redacted="text")
    return masked.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("ngram_jaccard", one_of_near_copies),
    ("secret_scan", secrets_masked),
    ("best_fit_packing", packed),
]
ORACLE_SQL = None  # models and tokenizers; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
