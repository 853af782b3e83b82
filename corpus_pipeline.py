"""The corpus pipeline: rules, classifier, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads back as the next stage's input.  All but the last
return the columns of documents.

Defined results: null text is empty, which the rules reject; rows repeated whole
are one document seen twice, of which near-dedup keeps one; of near copies, and
in every tie, the smallest id stays, a null id after all others; an empty table
passes every stage as such; other columns are dropped at the first stage;
texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import line_dedup, near_dedup, packing, quality_mil, quality_rules
from wardloom.llm.common import stored, table

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has them."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents; the rest lose their failing lines."""
    judged = quality_rules.apply_quality_rules(docs.select(*_COLUMNS))
    return _documents(judged.filter("kept").withColumn("text", F.col("clean_text")))


def _cleaned(docs: DataFrame) -> DataFrame:
    """Texts as the first stage leaves them; those of documents that it rejects as they came.

    What the rules leave of a rejected document may read well, so its label says nothing of that.
    """
    judged = quality_rules.apply_quality_rules(docs)
    return judged.withColumn("text", F.when(F.col("kept"), F.col("clean_text")).otherwise(F.col("text")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects.

    It is trained on the labelled rows of the whole table, cleaned like those it scores if the rules keep them.
    """
    model = quality_mil.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), prepare=_cleaned)
    scored = quality_mil.score_documents(docs, model, keep=tuple(_COLUMNS))
    return scored.filter("predicted = 1").select(*_COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated windows of lines and repeated long passages; a document left without any line goes."""
    cleaned = line_dedup.dedup_lines(docs.select(*_COLUMNS))
    return _documents(cleaned.filter("n_removed = 0 OR n_removed < n_lines"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return near_dedup.keep_one(docs.select(*_COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, with the sequence and offset that each goes to."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
