"""Readers and writers: JSON lines, JSON documents, files by directory, and element tables."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One object a line; without a schema the file is read once more to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Whole files of one JSON value; an array gives a row an element."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", True).json(path)


def write_json_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON array as one file: for small results; all rows go through one task."""
    rows.select(F.struct("*").alias("r")).agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(path)


def scan_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of one file, or of all files of a directory that match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


class Partitioner(Protocol):
    """Splits a file into elements: (category, page_number, text) in order."""

    def elements(self, content: bytes) -> list[tuple[str, int | None, str]]: ...


class PlainText:
    """Text files: pages end with form feeds; a paragraph in capitals is a title."""

    def elements(self, content: bytes) -> list[tuple[str, int | None, str]]:
        out = []
        for page, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
            for part in (p.strip() for p in text.split("\n\n")):
                if part:
                    out.append(("Title" if part.isupper() else "NarrativeText", page, part))
        return out


@dataclass(frozen=True)
class OcrPdf:
    """PDF files by the package ``unstructured``, where the executors have it; ``strategy`` is its own parameter."""

    strategy: str = "ocr_only"

    def elements(self, content: bytes) -> list[tuple[str, int | None, str]]:
        try:
            from unstructured.partition.pdf import partition_pdf
        except ImportError as e:
            raise ImportError("PDF files need the package unstructured, or a Partitioner of your own") from e
        found = partition_pdf(file=io.BytesIO(content), strategy=self.strategy)
        return [(e.category, e.metadata.page_number, e.text) for e in found]


def read_elements(files: DataFrame, partitioner: Partitioner) -> DataFrame:
    """(source, seq, category, page_number, text) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, i, *e) for path, content in zip(batch["path"], batch["content"], strict=True) for i, e in enumerate(partitioner.elements(bytes(content)))]
            yield pd.DataFrame(rows, columns=["source", "seq", "category", "page_number", "text"])

    return files.mapInPandas(run, "source string, seq int, category string, page_number int, text string")
