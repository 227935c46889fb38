"""Documents to packed training sequences: filters, near-duplicates, leaked items, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch, read_table
from foretoken.llm.decontamination import drop_contaminated as without_items
from foretoken.llm.language import fit_languages, language_of
from foretoken.llm.sequence_packing import pack_documents
from foretoken.llm.simhash import drop_near_duplicates
from foretoken.llm.toxicity import LIMIT, fit_toxicity, toxicity_of

# Words of a shingle, and bits in which fingerprints of near duplicates may differ.
SHINGLE, BITS = 4, 4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or if none was learned, go.

    How common a language is decides nothing: a short text that tells no language from another stays.
    """
    found = language_of(docs["text"], fit_languages(docs))
    return docs.where(found["score"] > 0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the limit; labels decide nothing by themselves."""
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity_of(docs["text"], model) < F.lit(LIMIT))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: that of the smallest id."""
    return drop_near_duplicates(docs, shingle=SHINGLE, bits=BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return without_items(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in the training sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Tokenisers, hashes and fitted models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read by the next."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
