"""The language-model stage: one interface, deterministic stand-ins, and row-wise map operators.

A model maps a batch of prompts to texts inside an Arrow stage; all else is Column expressions. The
number of partitions of the stage bounds how many calls run at once, and a failed task is tried again.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import combine, remove_answer_prefix, truncate_at_stops

Messages = Sequence[tuple[str, str]]


class ChatModel(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class EchoModel:
    """A stand-in: the last line of a prompt in a template."""

    template: str = "Answer: {}"

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.template.format(p.strip().rsplit("\n", 1)[-1]) for p in prompts]


@dataclass(frozen=True)
class QuotingModel:
    """A stand-in that speaks from its prompt: each rule is the beginning of a prompt's first line and what is made of the second line.

    A prompt that no rule knows is answered by its first line. So what a chain asks, and in what order, shows in its answers.
    """

    rules: tuple[tuple[str, Callable[[str], str]], ...] = ()

    def _say(self, prompt: str) -> str:
        head, _, rest = prompt.partition("\n")
        line = rest.partition("\n")[0]
        return next((make(line) for begins, make in self.rules if head.startswith(begins)), head)

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._say(p) for p in prompts]


@dataclass(frozen=True)
class LetterEmbedder:
    """A stand-in whose vectors are counts of characters: plain enough for SQL to follow."""

    letters: str = "abcdefghijklmnopqrstuvwxyz"

    @property
    def size(self) -> int:
        return len(self.letters)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not self.letters.isascii():
            return [[float(t.count(c)) for c in self.letters] for t in texts]
        # all letters are counted at once: in UTF-8 no other character has their bytes
        codes = np.frombuffer(self.letters.encode(), np.uint8)
        return [np.bincount(np.frombuffer(t.encode(errors="surrogatepass"), np.uint8), minlength=256)[codes].astype(float).tolist() for t in texts]


@dataclass(frozen=True)
class HttpChatModel:
    """A client of a text-generation server: POST of a prompt and parameters, the text under ``field``.

    The parameters are those of ``sampling_parameters``. One request a prompt, ``at_once`` at a time in
    each task; failures raise, so that Spark tries the task again.
    """

    url: str
    parameters: Mapping = field(default_factory=dict)
    timeout: float = 900
    field_name: str = "generated_text"
    at_once: int = 4

    def _ask(self, prompt: str) -> str:
        return post(self.url, {"inputs": prompt, "parameters": dict(self.parameters)}, self.timeout)[self.field_name]

    def generate(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(self._ask, prompts))


def post(url: str, body: dict, timeout: float, headers: Mapping[str, str] | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


@dataclass(frozen=True)
class ChatCompletionsModel:
    """A client of a server with the widespread chat-completions interface.

    ``generate`` gives texts; ``details`` each text with its tokens and their log probabilities, for
    ``call_with_details``. ``at_once`` requests at a time in each task.
    """

    url: str
    model: str
    parameters: Mapping = field(default_factory=dict)
    key: str = ""
    timeout: float = 900
    at_once: int = 4

    def _ask(self, prompt: str, logprobs: bool) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.parameters, **({"logprobs": True} if logprobs else {})}
        return post(f"{self.url.rstrip('/')}/chat/completions", body, self.timeout, {"Authorization": f"Bearer {self.key}"} if self.key else None)["choices"][0]

    def generate(self, prompts: list[str]) -> list[str]:
        with ThreadPoolExecutor(self.at_once) as pool:
            return [c["message"]["content"] for c in pool.map(lambda p: self._ask(p, False), prompts)]

    def details(self, prompts: list[str]) -> list[tuple[str, list[str], list[float]]]:
        with ThreadPoolExecutor(self.at_once) as pool:
            choices = list(pool.map(lambda p: self._ask(p, True), prompts))
        tokens = [(c.get("logprobs") or {}).get("content") or [] for c in choices]
        return [(c["message"]["content"], [t["token"] for t in ts], [float(t["logprob"]) for t in ts]) for c, ts in zip(choices, tokens, strict=True)]


@dataclass(frozen=True)
class HashingEmbedder:
    """A stand-in: counts of hashed words, of length 1; newlines are blanks."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for word in (t or "").replace("\n", " ").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.size] += 1 if h & (1 << 20) else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).tolist()


@dataclass(frozen=True)
class EncoderEmbedder:
    """An encoder of the widespread interface ``encode(texts, **options)`` as an embedder; ``load`` makes it, once a process.

    Newlines are blanks. The options of ``encode`` are bound once, here.
    """

    load: Callable[[], object]
    size: int
    options: Mapping = field(default_factory=dict)

    def embed(self, texts: list[str]) -> list[list[float]]:
        vectors = loaded(self.load).encode([t.replace("\n", " ") for t in texts], **self.options)
        return np.asarray(vectors, float).reshape(len(texts), self.size).tolist()


@cache
def loaded(load: Callable[[], object]) -> object:
    return load()


@dataclass(frozen=True)
class HttpEmbedder:
    """A client of an embedding server: POST of texts, a vector each in reply; ``batch`` texts a request."""

    url: str
    size: int
    batch: int = 32
    timeout: float = 900

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for i in range(0, len(texts), self.batch) for v in post(self.url, {"inputs": texts[i : i + self.batch]}, self.timeout)]


#: Sampling keys, any of which turns sampling on.
SAMPLING = ("top_k", "top_p", "temperature", "n")


def sampling_parameters(**given) -> dict:
    """Parameters of a call: a sampling key turns sampling on, a temperature of 0 off, and without sampling its keys go."""
    out = dict(given)
    if any(out.get(k) is not None for k in SAMPLING):
        out["do_sample"] = True
    if out.get("temperature") == 0:
        out["do_sample"] = False
    if not out.get("do_sample"):
        out = {k: v for k, v in out.items() if k not in SAMPLING}
    return out


def call_model(model: ChatModel, prompt: Column, stops: Sequence[str] = ()) -> Column:
    """The model's text for each prompt, cut at stops; null for a null prompt. Marked as not repeatable, so that no plan calls twice for one row."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        live = prompts.notna()
        said = model.generate(prompts[live].tolist()) if live.any() else []
        if len(said) != live.sum():
            raise ValueError(f"{len(said)} texts for {live.sum()} prompts")
        # put in one by one: numpy would make an array of texts as wide as the longest
        texts = iter(said)
        return pd.Series([next(texts) if asked else None for asked in live], index=prompts.index, dtype=object)

    return truncate_at_stops(run.asNondeterministic()(prompt), stops)


def call_with_details(model, prompt: Column) -> Column:
    """struct(text, token_ids, token_logprobs) for each prompt, of a model with ``details``; null for a null prompt."""

    @F.pandas_udf("text string, token_ids array<string>, token_logprobs array<double>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        live = prompts.notna()
        out = pd.DataFrame({c: [None] * len(prompts) for c in ("text", "token_ids", "token_logprobs")}, index=prompts.index, dtype=object)
        if live.any():
            for i, row in zip(prompts.index[live], model.details(prompts[live].tolist()), strict=True):
                out.loc[i] = pd.Series(list(row), index=out.columns, dtype=object)
        return out

    return run.asNondeterministic()(prompt)


def call_in_batches(model: ChatModel, prompt: Column, batch_size: int = 4, per_prompt: int = 1, keep_errors: bool = False) -> Column:
    """struct(texts, error) for each prompt, ``batch_size`` prompts a call of a model that gives ``per_prompt`` texts a prompt in one list.

    With ``keep_errors`` the prompts of a failed call are asked one by one, and one that fails again has
    its error as a value and null texts; else the error is raised, so that Spark tries the task again.
    Null prompts are not asked.
    """

    def ask(prompts: list[str]) -> list[tuple[list[str] | None, str | None]]:
        try:
            said = model.generate(prompts)
            if len(said) != per_prompt * len(prompts):
                raise ValueError(f"{len(said)} texts for {len(prompts)} prompts")
            return [(said[i * per_prompt : (i + 1) * per_prompt], None) for i in range(len(prompts))]
        except Exception as e:
            if not keep_errors:
                raise
            return [x for p in prompts for x in ask([p])] if len(prompts) > 1 else [(None, f"{type(e).__name__}: {e}")]

    @F.pandas_udf("texts array<string>, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        live = prompts[prompts.notna()]
        said = [x for i in range(0, len(live), batch_size) for x in ask(live.iloc[i : i + batch_size].tolist())]
        out = pd.DataFrame({"texts": None, "error": None}, index=prompts.index, dtype=object)
        for i, (texts, error) in zip(live.index, said, strict=True):
            out.at[i, "texts"], out.at[i, "error"] = texts, error
        return out

    return run.asNondeterministic()(prompt)


def embed(embedder: Embedder, text: Column, unit: bool = False) -> Column:
    """The embedder's vector of each text, of length 1 with ``unit`` (a zero vector stays); a null text is empty."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = embedder.embed(texts.fillna("").tolist())
        if unit and vectors:
            rows = np.asarray(vectors, float)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            vectors = (rows / np.where(length > 0, length, 1)).tolist()
        return pd.Series(vectors, index=texts.index)

    return run(text)


def fill(template: str, **columns: Column) -> Column:
    """A prompt template with ``{name}`` places filled by columns; a null column makes the prompt null."""
    parts, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(columns[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def map_rows(rows: DataFrame, model: ChatModel, template: str, out: str, stops: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Adds a column with the model's text for each row: the general map operator."""
    return rows.withColumn(out, call_model(model, fill(template, **columns), stops))


def _document_rows(rows: DataFrame, key: Sequence[str], documents: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, a row for each document with key, pos, text and ``carry``), both dealt by the key.

    What is dealt once needs no other exchange for grouping the documents again and joining them with their rows.
    """
    dealt = rows.repartition(*key)
    return dealt, dealt.select(*key, *carry, F.posexplode(documents).alias("pos", "text"))


def _gathered(done: DataFrame, key: Sequence[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return done.groupBy(*key).agg(F.transform(ordered, lambda d: d["text"]).alias("_docs"))


def map_documents(rows: DataFrame, key: str | Sequence[str], documents: str, fn, carry: Sequence[str] = ()) -> DataFrame:
    """Each text of an array column through ``fn`` (DataFrame of key, ``carry``, pos, text -> with a new text), put back in place.

    A row for each document is what spreads the calls over the cluster. Empty and null arrays stay. ``key`` is unique.
    """
    key = [key] if isinstance(key, str) else list(key)
    dealt, exploded = _document_rows(rows, key, documents, carry)
    joined = dealt.join(_gathered(fn(exploded), key), key, "left")
    return joined.withColumn(documents, F.coalesce("_docs", documents)).drop("_docs")


def filter_documents(rows: DataFrame, key: str | Sequence[str], documents: str, keep, carry: Sequence[str] = ()) -> DataFrame:
    """The texts of an array column that ``keep`` (DataFrame of key, ``carry``, pos, text -> with boolean ``kept``) accepts, in order."""
    key = [key] if isinstance(key, str) else list(key)
    dealt, exploded = _document_rows(rows, key, documents, carry)
    return dealt.join(_gathered(keep(exploded).where("kept"), key), key, "left").withColumn(documents, F.coalesce("_docs", F.array().cast("array<string>"))).drop("_docs")


@dataclass(frozen=True)
class RagPrompts:
    reason: str = "Use the rules below.\n{context}\n\nThink step by step, then answer.\nQuestion: {question}"
    answer: str = "{reasoning}\n\nState only the answer to: {question}"


#: Walks through the context in parts before it answers.
THREAD_OF_THOUGHT = RagPrompts(reason="Go through these rules part by part, and sum up each.\n{context}\n\nThen answer.\nQuestion: {question}")


def answer_questions(rows: DataFrame, model: ChatModel, sampling: ChatModel | None = None, prompts: RagPrompts = RagPrompts()) -> DataFrame:
    """Adds context (documents joined), cot_response (by the sampling model) and answer (by the base model, its prefix removed); keeps all columns."""
    out = rows.withColumn("context", combine("documents"))
    out = out.withColumn("cot_response", call_model(sampling or model, fill(prompts.reason, context=F.col("context"), question=F.col("question"))))
    # a column of its own first, as an expression that names a call several times makes it as often
    out = out.withColumn("answer", call_model(model, fill(prompts.answer, reasoning=F.col("cot_response"), question=F.col("question"))))
    return out.withColumn("answer", remove_answer_prefix("answer"))


def questions_for(model: ChatModel, text: Column, template: str = "List questions that this text answers, numbered.\n{doc}") -> Column:
    """The model's text for a chunk; parse it with ``parse_questions``."""
    return call_model(model, fill(template, doc=text))


def token_details(details: Column) -> Column:
    """struct(token_ids, token_texts, token_logprobs) of the tokens that are not special."""
    live = F.filter(details, lambda t: ~t["special"])
    pick = lambda name: F.transform(live, lambda t: t[name])
    return F.struct(pick("id").alias("token_ids"), pick("text").alias("token_texts"), pick("logprob").alias("token_logprobs"))


#: How roles open a message.
ROLE_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}


def chat_prompt(messages: Column) -> Column:
    """Messages (role, text) as one prompt that ends with the assistant's turn; raises on no messages and on a last one that is not the user's."""
    name = lambda m: F.coalesce(*[F.when(m["role"] == k, v) for k, v in ROLE_NAMES.items()])
    lines = F.array_join(F.transform(messages, lambda m: F.concat(name(m), F.lit(": "), m["text"])), "\n")
    last = F.element_at(messages, -1)["role"]
    checked = F.when(F.size(messages) < 1, F.raise_error(F.lit("no messages")).cast("string")).when(last != "user", F.raise_error(F.lit("the last message is not the user's")).cast("string"))
    return checked.otherwise(F.concat(lines, F.lit("\nAssistant:")))


def merge_system(messages: Column) -> Column:
    """For models without a system role: a leading system message is put before the next one, with a blank line; alone it becomes the user's."""
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    merged = F.struct(F.coalesce(second["role"], F.lit("user")).alias("role"), F.concat_ws("\n\n", first["text"], second["text"]).alias("text"))
    return F.when(first["role"] == "system", F.concat(F.array(merged), F.when(F.size(messages) > 2, F.slice(messages, F.lit(3), F.size(messages) - 2)).otherwise(F.slice(messages, 1, 0)))).otherwise(messages)


def regroup(outputs: Column, per_input: int) -> Column:
    """A flat array of generations as one array for each input."""
    n = F.ceil(F.size(outputs) / F.lit(per_input)).cast("int")
    return F.when(F.size(outputs) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(outputs, i * per_input + 1, per_input))).otherwise(F.array().cast("array<array<string>>"))


def generated_part(ids: Column, input_length: Column) -> Column:
    """What was generated after a prompt of that many tokens."""
    return F.slice(ids, input_length + 1, F.greatest(F.size(ids) - input_length, F.lit(0)))


def scored_tokens(tokens: Column, scores: Column) -> Column:
    """array of struct(token, score, probability) of generated tokens and their log probabilities; what has no partner is null."""
    pairs = F.arrays_zip(tokens.alias("token"), scores.alias("score"))
    return F.transform(pairs, lambda p: F.struct(p["token"].alias("token"), p["score"].alias("score"), F.exp(p["score"]).alias("probability")))


def fill_messages(templates: Messages, **columns: Column) -> Column:
    """(role, template) pairs as an array of messages, their places filled by columns; join such arrays with ``F.concat``."""
    return F.array(*[F.struct(F.lit(role).alias("role"), fill(template, **columns).alias("text")) for role, template in templates])
