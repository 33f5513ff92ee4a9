"""Tasks that are one prompt a row: each is a template for ``map_rows`` and the columns that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import chat

TASKS = {
    "quote": "Copy, word for word, the sentences of the text that bear on the question. Say NONE if there are none.\nText:\n{context}\nQuestion: {question}",
    "rewrite": "Write the text anew in plain words, and leave nothing out.\n{context}",
    "rephrase": "Ask the question again in other words, then list the terms in it that need a definition.\n{question}",
    "critique": "The answer to the question is wrong. Say which step of the reasoning fails and why.\nQuestion: {question}\nReasoning: {reasoning}\nRight answer: {truth}",
    "contradictions": "Do any of these responses contradict each other? Name those that do.\n{responses}",
    "consensus": "Write one response that says what most of these responses say.\n{responses}\nQuestion: {question}",
}


def run_task(rows: DataFrame, model: chat.ChatModel, task: str, out: str = "said", **columns: Column) -> DataFrame:
    """Adds the model's text for a task of ``TASKS``; places are filled by the columns given, else by those of the same name. A null in one makes it null."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}; there are {', '.join(TASKS)}")
    named = {c: F.col(c) for c in rows.columns} | columns
    return chat.map_rows(rows, model, TASKS[task], out, **named)
