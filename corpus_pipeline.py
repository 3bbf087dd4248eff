"""The corpus pipeline: quality rules, line dedup, near-duplicate join, benchmark decontamination, packing.

Each stage is one operator of noticeflow.llm over all that its predecessor kept. Run it with run(spark, sf_dir).

What all stages define alike: an empty table gives no rows; repeated rows are rows of their own, unless a stage says
otherwise; columns that a stage doesn't read, whatever their names, keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeflow.llm import decontam, jaccard, linededup, packing, rules
from noticeflow.llm.queries import WORD_BPE, table, tokenizer_file
from noticeflow.llm.shared import table_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects.

    Null and empty texts have no words and go; a null doc_id has no label and is judged like any other row.
    """
    return rules.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that are boilerplate on their site; equal texts count as one page of it.

    A page that would lose most of its text keeps it, but for lines on most of the site's pages. A null source is a site;
    null texts stay null, and every row stays.
    """
    return linededup.cleaned(docs, texts=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at 0.75: that of the smallest doc_id.

    Texts without words link with nothing and stay, as do rows without a doc_id; rows of the smallest doc_id stay together.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark (of an item with fewer: no whole item).

    Null and empty texts have no words and stay; items without words, and null ones, match nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document; null and empty texts are a document of the end id alone."""
    return packing.pack(docs, tokenizer_file(WORD_BPE), fold=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: SQL has neither the learned rules nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = table_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
