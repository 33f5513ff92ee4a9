"""Question-answer pairs from a model's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import strip, strip_qa_prefix
from quire.operators import chat
from quire.plans.storage import durable


def parse_qa_pairs(texts: DataFrame, key: str, expected: int) -> DataFrame:
    """(key, pair, question, answer) of texts with exactly ``expected`` well-formed pairs; all other texts are dropped.

    A line that ends with ``?`` opens a pair and the lines up to the next make its answer; blank lines do
    not count. A text is not well-formed if a line stands before the first question or an answer is empty.
    """
    lines = texts.select(key, F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line")).withColumn("line", strip("line")).where("line <> ''")
    asks = F.col("line").endswith("?")
    pair = F.sum(asks.cast("int")).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    parts = F.transform(F.array_sort(F.collect_list(F.when(~asks, F.struct("pos", "line")))), lambda p: p["line"])
    pairs = lines.withColumn("pair", pair).groupBy(key, "pair").agg(F.max(F.when(asks, F.col("line"))).alias("question"), F.array_join(parts, " ").alias("answer"))
    good = F.min(((F.col("pair") > 0) & (F.col("answer") != "")).cast("int")).over(W.partitionBy(key))
    kept = pairs.withColumns({"good": good, "n": F.count("*").over(W.partitionBy(key))}).where((F.col("good") == 1) & (F.col("n") == expected))
    return kept.select(key, "pair", strip_qa_prefix("question").alias("question"), strip_qa_prefix("answer").alias("answer"))


ASK_PAIRS = "Write 3 questions that this text answers, each with its answer on the next line.\n{doc}"


def create_qa_pairs(docs: DataFrame, key: str, model: chat.ChatModel, expected: int = 3, template: str = ASK_PAIRS) -> DataFrame:
    """(key, pair, question, answer) that a model writes about texts; a text whose reply has not ``expected`` pairs is skipped."""
    replies = durable(docs.select(key, chat.call_model(model, chat.fill(template, doc=F.col("text"))).alias("text")), "qa-pairs")
    return parse_qa_pairs(replies.where("text is not null"), key, expected)
