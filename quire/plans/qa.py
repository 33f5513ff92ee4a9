"""Whole plans: building an index from elements, and answering questions with self-consistency."""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import choose, chosen_index, format_responses, parse_questions
from quire.operators import chat, consistency, etl, retrieval
from quire.plans.storage import durable
from quire.streaming.trace import RunLog

INDEX_TYPES = ("parent_document", "hypothetical_queries")


@dataclass(frozen=True)
class QaOptions:
    """``compress`` comes after ``reword`` and only counts with it; ``limit`` is applied before the filter."""

    reword: bool = True
    self_consistency: bool = True
    llm_filter: bool = True
    compress: bool = False
    thread_of_thought: bool = False
    limit: int | None = 5
    samples: int = 9
    strategy: str = "average_similarity"


def build_index(docs: DataFrame, kind: str, embedder: chat.Embedder, *, model: chat.ChatModel | None = None, parent_size: int = 500, parent_overlap: int = 50, child_size: int = 125, child_overlap: int = 12, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors): chunks have (chunk_id, text), vectors (id, parent_id, vector). Texts are split recursively, sizes in tokens of a tokenizer file, or in words. Vectors have length 1.

    Both are written to the shared folder: each document is split, and each unit embedded, once.

    parent_document: vectors of child chunks, or of the chunks themselves if ``child_size`` is 0.
    hypothetical_queries: vectors of questions that a model asks about each chunk.
    """
    if kind not in INDEX_TYPES:
        raise ValueError(f"unknown index type {kind}; there are {', '.join(INDEX_TYPES)}")
    parents = etl.recursive_chunks(docs.select("doc_id", "text"), parent_size, parent_overlap, "tokens", tokenizer)
    chunks = durable(parents.select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), F.col("chunk").alias("text")), "qa-chunks")
    if kind == "hypothetical_queries":
        if model is None:
            raise ValueError("questions need a chat model")
        asked = durable(chunks.withColumn("q", parse_questions(chat.questions_for(model, F.col("text")))), "qa-questions")
        units = asked.select(F.col("chunk_id").alias("parent_id"), F.posexplode("q").alias("n", "text"))
    elif child_size > 0:
        units = etl.recursive_chunks(chunks.withColumnRenamed("chunk_id", "parent_id"), child_size, child_overlap, "tokens", tokenizer).select("parent_id", F.col("chunk_index").alias("n"), F.col("chunk").alias("text"))
    else:
        units = chunks.select(F.col("chunk_id").alias("parent_id"), F.lit(0).alias("n"), "text")
    return chunks, durable(units.select(F.concat_ws("-", "parent_id", "n").alias("id"), "parent_id", chat.embed(embedder, F.col("text"), unit=True).alias("vector")), "qa-vectors")


@dataclass(frozen=True)
class Retriever:
    """A saved index with what it was built for: its kind and how many chunks a question gets."""

    chunks: DataFrame
    vectors: DataFrame
    kind: str
    k: int

    def find(self, questions: DataFrame, embedder: chat.Embedder, limit: int | None = None) -> DataFrame:
        """(query_id, documents): the texts found for questions (question_id, question), best first."""
        asked = questions.select(F.col("question_id").alias("id"), chat.embed(embedder, F.col("question"), unit=True).alias("vector"))
        return retrieval.ranked_contexts(retrieval.parent_documents(durable(asked, "qa-queries"), self.vectors, self.k), self.chunks, "chunk_id", limit)


def save_index(chunks: DataFrame, vectors: DataFrame, path: str, kind: str = "parent_document", k: int = 10) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.sparkSession.createDataFrame([(kind, k)], "kind string, k int").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def add_documents(path: str, docs: DataFrame, kind: str, embedder: chat.Embedder, **options) -> None:
    """More documents for a saved index: their chunks and vectors are appended. A document that is there already raises, and nothing is written."""
    chunks, vectors = build_index(docs, kind, embedder, **options)
    chunks = durable(chunks, "qa-added")
    there = docs.sparkSession.read.parquet(f"{path}/chunks").select("chunk_id")
    if twice := chunks.join(there, "chunk_id", "left_semi").select("chunk_id").first():
        raise ValueError(f"chunk {twice['chunk_id']} is in the index already")
    chunks.write.mode("append").parquet(f"{path}/chunks")
    vectors.write.mode("append").parquet(f"{path}/vectors")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")


def load_retriever(spark, path: str) -> Retriever:
    told = spark.read.schema("kind string, k int").json(f"{path}/settings").first()
    return Retriever(*load_index(spark, path), told["kind"], told["k"])


#: Prompts for a document: is it kept, said anew, and cut down to the question.
JUDGE, REWORD, EXTRACT = "Is this of use for {q}? Answer yes or no.\n{t}", "Say this in clear words.\n{t}", "Extract what helps to answer {q}.\n{t}"


def _children_for(vectors: DataFrame, limit: int | None, k: int) -> int:
    """As many of the k nearest vectors as tell the first ``limit`` chunks: each chunk before the last can have all its vectors before it."""
    if limit is None or limit < 1:
        return k
    most = vectors.groupBy("parent_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return min(k, (limit - 1) * most + 1)


def answer(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, model: chat.ChatModel, embedder: chat.Embedder, options: QaOptions = QaOptions(), k: int = 20, sampling: chat.ChatModel | None = None, log: RunLog | None = None) -> DataFrame:
    """(question_id, question, answer) for questions (question_id, question); question_id is unique.

    The k nearest chunks, of these the first ``limit``, of these those that the model keeps. For each sample they are put
    in another order, said anew, and then, with ``compress``, cut down to what helps; the answer is reasoned out by the
    sampling model and stated by the model, and one of the samples is picked. With ``log``, each step that asks or
    retrieves is a run in it, within that of the whole; the pick is planned there and runs when its rows are read.
    """
    consistency.check_strategy(options.strategy, model is not None)
    step = log.run if log else lambda *_, **__: nullcontext()
    with step("answer", "chain", inputs=asdict(options)):
        with step("retrieve", "chain", inputs={"k": k}):
            asked = durable(questions.select(F.col("question_id").alias("id"), chat.embed(embedder, F.col("question"), unit=True).alias("vector")), "qa-queries")
            found = retrieval.parent_documents(asked, vectors, _children_for(vectors, options.limit, k))
            contexts = retrieval.ranked_contexts(found, chunks, "chunk_id", options.limit).withColumnRenamed("query_id", "question_id")
            rows = questions.select("question_id", "question").join(contexts, "question_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))
            rows = durable(rows, "qa-documents")
        if options.llm_filter:
            with step("filter", "llm"):
                judge = lambda d: chat.map_rows(d, model, JUDGE, "says", q=F.col("question"), t=F.col("text")).withColumn("kept", ~F.lower("says").startswith("no"))
                rows = durable(chat.filter_documents(rows, "question_id", "documents", judge, carry=["question"]), "qa-kept")
        rows = consistency.repeat(rows, options.samples if options.self_consistency else 1)
        if options.self_consistency:
            rows = rows.withColumn("documents", consistency.alternate_ordering(F.col("documents"), F.col("sample")))
        # samples are meant to differ, so they are worded by the model that samples
        voice = sampling or model if options.self_consistency else model
        for name, task in (("reword", REWORD), *((("extract", EXTRACT),) if options.compress else ())) if options.reword else ():
            with step(name, "llm"):
                say = lambda d, task=task: chat.map_rows(d, voice, task, "new", q=F.col("question"), t=F.col("text")).select("question_id", "sample", "pos", F.col("new").alias("text"))
                rows = durable(chat.map_documents(rows, ["question_id", "sample"], "documents", say, carry=["question"]), f"qa-{name}")
        with step("reason", "llm"):
            prompts = chat.THREAD_OF_THOUGHT if options.thread_of_thought else chat.RagPrompts()
            answered = durable(chat.answer_questions(rows, model, sampling, prompts), "qa-answers")
        if not options.self_consistency:
            return answered.select("question_id", "question", "answer")
        with step("pick", "chain", inputs={"strategy": options.strategy}):
            return pick(answered, options.strategy, model, embedder)


def pick(answered: DataFrame, strategy: str, model: chat.ChatModel | None, embedder: chat.Embedder) -> DataFrame:
    """One answer for each question of rows (question_id, question, sample, cot_response, answer, context).

    With columns token_ids and token_logprobs, as a model's details give them, bigram_consistency is over
    these; else over the words of cot_response, each of log probability 0. Answers of any length count.
    """
    consistency.check_strategy(strategy, model is not None)
    details = [c for c in ("token_ids", "token_logprobs") if c in answered.columns]
    named = answered.select(F.col("question_id").alias("group_id"), F.col("sample").alias("resp_id"), "question", "answer", "cot_response", "context", *details)
    if strategy == "average_similarity":
        # written, as they are read several times
        best = consistency.majority_consensus(durable(named.select("group_id", "resp_id", F.col("answer").alias("text"), chat.embed(embedder, F.col("answer")).alias("vector")), "qa-answer-vectors"))
    elif strategy == "bigram_consistency":
        if len(details) == 2:
            tokens = named.withColumns({"tokens": F.transform("token_ids", lambda x: x.cast("string")), "logprobs": F.col("token_logprobs")})
        else:
            tokens = consistency.tokenize(named.withColumn("text", F.col("cot_response")))
        scores = consistency.consistency_scores(tokens.select("group_id", "resp_id", "tokens", "logprobs"), 2, True, True)
        best = consistency.ranked(scores.withColumn("score", F.round("score", 9))).where("rank = 1")
    else:
        grouped = named.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("resp_id", "answer"))).alias("r"), F.first("question").alias("question"), F.first("context").alias("context"))
        answers = F.transform("r", lambda x: x["answer"])
        ask = "Which response agrees most with the others? Say: The most consistent response is Response <number>\n{c}{r}\n{q}"
        context = F.col("context") if strategy == "prompting_with_context" else F.lit("")
        said = chat.map_rows(grouped, model, ask, "said", c=context, r=format_responses(answers), q=F.col("question"))
        return said.select(F.col("group_id").alias("question_id"), "question", choose(answers, chosen_index("said")).alias("answer"))
    return named.join(best.select("group_id", "resp_id"), ["group_id", "resp_id"]).select(F.col("group_id").alias("question_id"), "question", "answer")
