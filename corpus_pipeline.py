"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and its rows are written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import langid, linededup, packing, simhash
from brindle.llm.common import discard, packed, saved, table, unpacked

#: A document whose best language has a smaller posterior is rejected, as is one without letters.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: learned from the labelled rows of the stage's input, held-out fold excepted. Null texts and texts without letters go; columns of any name pass; an empty table stays empty."""
    model = langid.fit(docs.where(langid.fold("doc_id", 4) != 2))
    found = langid.identify(docs, model, keep=[packed(docs).alias("doc")])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*unpacked(docs, "doc"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated chunks and runs of lines; n_chars follows the text. What has become empty goes, null texts with it; repeated ids and other columns stay."""
    out = linededup.dedup_lines(docs, run_words=linededup.RUN_WORDS)
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where("text is not null and text <> ''").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; of rows that repeat that id the one whose columns hash lowest."""
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("best_fit_packing", pack_sequences)]

#: Naive Bayes over hashed n-grams, XXH64 and BPE have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        kept.append(docs)
    out = saved(STAGES[-1][1](spark, docs, sf_dir))
    discard(*kept)
    return out
