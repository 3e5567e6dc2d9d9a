"""A training-corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents;
texts that the third stage shortens stay rows, with n_chars counted anew. The last adds the ids of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, sentencepiece_ops, simhash, suffix_dedup, toxicity
from skein.llm.common import load
from skein.session import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.THRESHOLD or more go. The model learns from the labels that aren't held out."""
    model = toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents one row stays, that of the smallest doc_id."""
    return simhash.keep_row(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 200-byte strings that occur more than once are taken out of the texts."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_contamination(docs, load(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, the ids of the text and their number."""
    ids = sentencepiece_ops.encode(docs.select("doc_id", "text"))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", to_tokens),
]

#: The learnt scores, byte cuts and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written as Parquet to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    top = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
