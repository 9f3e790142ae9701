"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import common, decontam, langid, line_dedup, ngram_join, packing

#: A prediction below this is no language the network knows.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not null, not without letters, not scored below ``LEAST_SCORE``.

    Without a label to learn from there are no scores, and only texts that are null or have no letter are left out.
    """
    net = langid.fit(docs)
    known = langid.predict(docs, net, docs.columns)
    pred, score = (F.col(f"`{c}`") for c in known.columns[-2:])
    passes = score < 1 if net is None else (pred != "und") & (score >= LEAST_SCORE)
    return known.where(passes).select(*[f"`{c}`" for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents share."""
    return line_dedup.dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return ngram_join.keep_one_of_each(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        done = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.drop_stored(before)
        docs = before = done
    return docs
