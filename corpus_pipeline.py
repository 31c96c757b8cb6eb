"""A training corpus from raw documents: language ID, near-dedup, sanitisation of personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, packing, pii, simhash
from corpusloom.llm.common import fresh, table, written

#: Words that a worker of the last stage remembers: fewer than packing alone would, as the stages share the executors' memory.
REMEMBERED = 200_000
#: SQL cannot express learning, fingerprints of words or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without a letter go. Very long texts count as a whole, rows that repeat go or stay alike, no rows give none, and columns of any name stay."""
    model = langid.train(docs.where(~langid.held_out()), F.col("doc_id"))
    found, score = fresh(docs, "_lang", "_score")
    told = langid.identify(docs, model, lang=found, score=score)
    return told.where(F.col(found) != langid.UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; the rules for nulls, ties, repeats and clashing names are those of `simhash.deduplicate`."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced; n_chars follows the text. Other rules are those of `pii.sanitise`."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.packed(docs, remembered=REMEMBERED)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("pii", personal_data), ("best_fit_packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each one's result written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
