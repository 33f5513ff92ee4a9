"""Judging answers with a model: samples of grades, the vote over them, and the accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import combine, format_answers, grade
from quire.operators import chat, consistency, evaluation
from quire.plans.storage import durable

PROMPT = "Question: {query}\n{truth}\n{examples}\nGiven answer: {prediction}\nDoes it agree? End with GRADE: CORRECT or GRADE: INCORRECT"


def judge(cases: DataFrame, model: chat.ChatModel, samples: int = 5, template: str = PROMPT) -> DataFrame:
    """(case_id, score, value, reasoning, ratio_correct) of cases (case_id, query, prediction, true_answers, examples).

    With one sample the grade is taken as read, and a case without a readable one has nulls.
    """
    asked = consistency.repeat(cases, samples)
    said = chat.map_rows(asked, model, template, "said", query=F.col("query"), truth=format_answers("true_answers"), examples=combine("examples", "\n"), prediction=F.col("prediction"))
    graded = durable(said.select("case_id", "sample", "said"), "grades").select("case_id", "sample", grade("said").alias("grade"))
    if samples == 1:
        g = F.col("grade")
        return graded.select("case_id", g["score"].alias("score"), g["value"].alias("value"), g["reasoning"].alias("reasoning"), g["score"].cast("double").alias("ratio_correct"))
    return evaluation.consensus(graded, "case_id", "sample")


def evaluate(cases: DataFrame, model: chat.ChatModel, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """The cases with their grades, and the accuracy."""
    grades = judge(cases, model, samples)
    return cases.join(grades, "case_id"), evaluation.accuracy(grades)
