"""Corpus pipeline: language, quality, near duplicates, mixing and encoding, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. ``run`` applies them to the documents table, with a table in
the shared folder between one stage and the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, langid, mixing, near_dup, quality
from vigil.llm.common import made, stored, sweep, table, unused
from vigil.llm.queries import tokenizer_file

#: A document is rejected if no language has this share of it.
MIN_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters or without a prevailing language go.

    Learns from all labels there are, those that the query of the operator holds out included.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    out = unused(docs, "_language")
    got = langid.predict(docs, model, out=out)
    return got.filter((F.col(f"{out}.lang") != langid.UNKNOWN) & (F.col(f"{out}.score") >= MIN_SHARE)).select(*docs.columns)


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that their source repeats go, and so do documents that fail the base rules or are depleted without those lines."""
    good = quality.keep_good(docs)
    return good.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else good


def distinct_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return near_dup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, from none to three times."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of their decoding."""
    got = bpe.encode(docs, tokenizer_file("word_bpe_49k.json"))
    return got.select(
        "doc_id",
        "lang",
        "source",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.col("bpe.ids").alias("ids"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language identification", language),
    ("quality rules", good_text),
    ("near-duplicate removal", distinct_text),
    ("source mixing", mixed),
    ("BPE encoding and decoding", encoded),
]

#: The first stage is a learned model, so SQL can't express the pipeline; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        sweep(docs, before)  # what earlier stages wrote isn't read again
    return STAGES[-1][1](spark, docs, sf_dir)
