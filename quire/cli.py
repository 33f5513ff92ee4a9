"""Builds an index of the files of a directory: ``python -m quire.cli --type parent_document --input DIR --output DIR``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.functions.tokenizers import resolve_tokenizer, served_model
from quire.operators import chat, etl
from quire.plans import qa
from quire.sources import files


def known_tokenizers(folder: str | None) -> dict[str, str]:
    """Tokenizer files of a folder by the part of a model's id that they are named after (``big-7b.json``); longer names first."""
    found = sorted(Path(folder).glob("*.json"), key=lambda p: (-len(p.stem), p.stem)) if folder else []
    return {p.stem: str(p) for p in found}


def build(
    spark: SparkSession, kind: str, source: str, target: str, pattern: str = "*.txt", endpoint: str | None = None, partitioner: files.Partitioner | None = None, tokenizer: str | None = "words",
    embedder: chat.Embedder | None = None, k: int = 20, tokenizers: str | None = None,
) -> None:
    """Files to elements to documents to chunks and vectors, saved as tables with k. A model is only asked for hypothetical queries.

    ``tokenizer``: a tokenizer file, or ``words``; without one, that of the model which the endpoint serves, sought in the folder
    ``tokenizers``. ``embedder``: by default the hashing stand-in.
    """
    if not tokenizer:
        tokenizer = resolve_tokenizer(None, served_model(endpoint) if endpoint else None, known_tokenizers(tokenizers))
        if not tokenizer:
            raise ValueError("no tokenizer is known for the endpoint's model")
    elements = files.read_elements(files.scan_files(spark, source, pattern), partitioner or files.PlainText())
    pages = etl.elements_to_documents(elements)
    docs = pages.select(F.concat_ws("#", "source", "page_run").alias("doc_id"), "text")
    model = chat.HttpChatModel(endpoint) if endpoint else None
    index = qa.build_index(docs, kind, embedder or chat.HashingEmbedder(), model=model, tokenizer=None if tokenizer == "words" else tokenizer)
    qa.save_index(*index, target, kind, k)


def served_embedder(url: str) -> chat.HttpEmbedder:
    """A client of an embedding server, whose size is that of one vector it gives."""
    return chat.HttpEmbedder(url, len(chat.HttpEmbedder(url, 0).embed(["size"])[0]))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--type", choices=qa.INDEX_TYPES, default="parent_document")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--pattern", default="*.txt")
    parser.add_argument("--endpoint")
    parser.add_argument("--tokenizer", help="a tokenizer file, or words; else that of the endpoint's model")
    parser.add_argument("--tokenizers", help="a folder of tokenizer files, each named after a part of a model's id")
    parser.add_argument("--embedder", help="the address of an embedding server; else the hashing stand-in")
    parser.add_argument("--k", type=int, default=20, help="chunks that a question gets")
    given = parser.parse_args(args)
    embedder = served_embedder(given.embedder) if given.embedder else None
    build(SparkSession.builder.getOrCreate(), given.type, given.input, given.output, given.pattern, given.endpoint, tokenizer=given.tokenizer, embedder=embedder, k=given.k, tokenizers=given.tokenizers)


if __name__ == "__main__":
    main()
