"""Corpus preparation: quality, lines, near duplicates, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.decontaminate import contamination
from rankweave.llm.line_dedup import without_shared_lines
from rankweave.llm.minhash_dedup import near_duplicates
from rankweave.llm.quality_classifier import good_documents
from rankweave.llm.queries import good_labels, tokens_with_digests
from rankweave.llm.shared import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps, whole rows.

    Null, empty and blank texts are rated by their metadata and the marks of no words, very long ones
    whole; a tie with the threshold is kept; rows that repeat a doc_id are rated each, a null doc_id has no label. An
    empty table stays empty.
    """
    return good_documents(docs, good_labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without blocks of lines that an earlier one has; one whose last text this takes goes.

    n_chars is that of what is left. Null, empty and blank texts stay, very long ones count whole;
    rows of one doc_id take nothing from each other and a null doc_id is in no order. An empty table stays empty.
    """
    out = without_shared_lines(docs, carry=("lang", "source", "n_chars"))
    out = out.where(F.col("n_deleted").eqNullSafe(0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_deleted") > 0, F.length("kept_text")).otherwise(F.col("carried.n_chars")).cast("long")
    return out.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", size.alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates.

    Null, empty and blank texts and null doc_ids are in no group and stay; very long texts count
    whole; the smallest doc_id of a group stays, with all rows that repeat it. An empty table stays empty.
    """
    others = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of the benchmark.

    Null, empty and wordless texts stay, very long ones count whole; of a doc_id that repeats all rows
    go or stay; a null doc_id stays. An empty table stays empty, and all stay where the benchmark is empty.
    """
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(hit, "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with digests of the ids and of the text decoded from them.

    Null and empty texts have no tokens, very long ones all of theirs; a null doc_id is kept, each
    row that repeats a doc_id gives one, and an empty table none.
    """
    return tokens_with_digests(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]
#: SQL cannot express training, alignment or merging; the tests hold the rows against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents; what a stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
