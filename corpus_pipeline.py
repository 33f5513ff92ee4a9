"""A pipeline over ``documents``: five stages, each over what the one before has kept, written as Parquet in between.

1. toxicity: documents that the classifier rejects go; the model learns from labelled documents.
2. near_duplicates: of each class of texts that links of similarity 0.8 connect, the one of least doc_id stays.
3. decontamination: documents with words in a window of a benchmark item go.
4. secrets: spans of secrets are replaced by a mark; no document goes.
5. mixing: documents in the mix stay, with the words that the mix takes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, mixing, secrets, similar_texts, toxicity
from quire.plans.storage import discard, durable, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, for operators that return a row for each doc_id: ids may be null or repeat."""
    return durable(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def _as_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows but those gone. The numbers are written first, so that their size is known to the planner: few are sent to all tasks, and texts are only shuffled for many."""
    return rows.join(durable(gone, "pipeline-gone"), "row", "left_anti").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no evidence and stay; each of repeated rows is judged alike; without labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.train_toxicity(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents without doc_id, and of several rows of the least one, the first row stays."""
    rows = _keyed(docs)
    classes = similar_texts.link_similar(_as_ids(rows)).select(F.col("doc_id").alias("row"), "class_id")
    named = durable(rows.select("row", "doc_id").join(classes, "row"), "pipeline-classes")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    return _without(rows, named.select("row").join(first, "row", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold no window and stay; each of repeated rows is judged by itself, whatever its doc_id."""
    rows = _keyed(docs)
    hits = decontamination.benchmark_hits(_as_ids(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, hits.where("contaminated").select(F.col("doc_id").alias("row")))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; null texts stay null, and ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    return secrets.redact(docs, secrets.train_scanner(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of equal doc_id, source and size are in the mix alike; a null source is one of its own, and texts without words are not in the mix."""
    rows = _keyed(docs)
    taken = mixing.mix_sources(rows, carry=["row"]).where("taken > 0").select("row", "taken", "target")
    return rows.join(taken, "row").select(*COLUMNS, "taken", "target")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", scan_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from what the one before has written; an empty table gives an empty one.

    When a stage is written, its own tables go, and so does what the stage before has written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            kept = keep(durable(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = kept
    return docs


#: A trained classifier, a trained network and the set join are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
