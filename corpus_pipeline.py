"""From raw documents to token ids: five stages, each one of the operators in ``trackloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. Nulls, empty and
repeated rows are treated as the operators' docstrings say. All stages but the last keep the columns of their input,
those beyond the columns of ``documents`` too; the last one gives ids in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common, contam, exact, pieces, simhash, toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labels of rows not held out."""
    return toxic.drop_toxic(docs, toxic.train(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more the one with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    return contam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the byte where each piece starts."""
    made = pieces.encode(docs, pieces.model_bytes(), "doc_id", "lang", "source")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "span_start")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can't express a trained classifier, fingerprints or byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared folder and read by the next; then
    what it read itself is deleted."""
    docs, path = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.keep(docs, f"{path}/{i}-{name}")
        if 0 < i < len(STAGES) - 1:
            common.forget(spark, f"{path}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
