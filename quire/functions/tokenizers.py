"""Tokenizers behind one interface: white space by default, others from a vocabulary file that all executors can read."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import whitespace_tokens


@cache
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer(path: str | None = None) -> Callable[[Column], Column]:
    """A function of a text column to its tokens; ``path``: a tokenizer file, else words between white space.

    The pieces of a file's tokenizer are spans of the text, so that chunks of them are readable.
    """
    if path is None:
        return whitespace_tokens

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        live = texts.fillna("").tolist()
        encoded = _load(path).encode_batch(live, add_special_tokens=False)
        return pd.Series([[t[a:b] for a, b in e.offsets] for t, e in zip(live, encoded, strict=True)], index=texts.index)

    return run


def count_tokens(path: str | None = None) -> Callable[[str], int]:
    """A function of a text to the number of its tokens, for tasks; ``path`` as for ``tokenizer``."""
    if path is None:
        return lambda text: len(text.split())
    return lambda text: len(_load(path).encode(text, add_special_tokens=False).ids)


def served_model(endpoint: str, timeout: float = 30) -> str:
    """The id of the model that a text-generation server says it serves."""
    with urllib.request.urlopen(f"{endpoint.rstrip('/')}/info", timeout=timeout) as reply:
        return json.load(reply)["model_id"]


def resolve_tokenizer(path: str | None, endpoint: str | None, known: dict[str, str]) -> str | None:
    """A path wins over an endpoint; an endpoint's model name is looked up by the part of it that is known."""
    if path:
        return path
    if not endpoint:
        raise ValueError("a tokenizer or an endpoint is needed")
    return next((v for k, v in known.items() if k in endpoint), None)
