import math
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chat, consistency, etl, evaluation, qa_pairs, retrieval
from quire import cli
from quire.functions.tokenizers import resolve_tokenizer, tokenizer
from quire.plans import grading, qa
from quire.sources import files
from quire.streaming import trace

ELEMENT = "source string, seq int, category string, page_number int, text string"
RESPONSE = "group_id int, resp_id int, tokens array<string>, logprobs array<double>"


def fold(elements):
    """The sentence repair as a plain loop."""
    out = []
    for category, text in elements:
        ends = lambda s: s.strip().endswith((".", "?", "!", ".)", "?)", "!)"))
        if out and (category == "NarrativeText" or ends(text)) and out[-1][0] == "NarrativeText" and not ends(out[-1][1]):
            out[-1][1] += " " + text
        else:
            out.append([category, text])
    return [tuple(x) for x in out]


def test_dangling_sentences_are_the_fold(spark):
    rng = random.Random(1)
    docs = {str(d): [(rng.choice(["Title", "NarrativeText", "ListItem"]), rng.choice(["a", "b.", "c?)", "d!"])) for _ in range(8)] for d in range(60)}
    rows = [(d, i, c, 1, t) for d, es in docs.items() for i, (c, t) in enumerate(es)]
    got = etl.fix_dangling_sentences(spark.createDataFrame(rows, ELEMENT)).orderBy("source", "seq").collect()
    for d, es in docs.items():
        assert [(r["category"], r["text"]) for r in got if r["source"] == d] == fold(es)


def test_sections_and_pages(spark):
    rows = [("a", i, c, p, c[0]) for i, (c, p) in enumerate([("Title", 1), ("Title", 1), ("Narr", 1), ("Title", 1), ("Narr", 1), ("Title", 2), ("Title", 2), ("Narr", 2), ("Title", 1)])]
    df = spark.createDataFrame(rows, ELEMENT)
    assert [r["section"] for r in etl.sections(df).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2, 2, 2, 3]
    assert [r["section"] for r in etl.sections(df, every_title=True).orderBy("seq").collect()] == [0, 1, 1, 2, 2, 3, 4, 4, 5]
    docs = etl.page_documents(etl.page_runs(etl.sections(df))).orderBy("page_run").collect()
    assert [(r["page_number"], r["text"]) for r in docs] == [(1, "T\nT\nN\n\nT\nN"), (2, "T\nT\nN"), (1, "T")]


def test_empty_elements(spark):
    assert etl.elements_to_documents(spark.createDataFrame([], ELEMENT)).count() == 0


def test_recursive_split():
    text = "aa bb\n\ncc dd ee\nff"
    assert etl.split_recursively(text, 8, 0) == ["aa bb", "cc dd ee", "ff"]
    assert all(len(c) <= 10 for c in etl.split_recursively("word " * 50 + "x" * 25, 10, 4))
    assert etl.split_recursively("a b c d", 3, 1) == ["a b", "b c", "c d"]


def scores(spark, rows, *args):
    return {r["resp_id"]: r["score"] for r in consistency.consistency_scores(spark.createDataFrame(rows, RESPONSE), *args).collect()}


def test_unigram_agreement(spark):
    rows = [(1, 0, ["a", "b"], [0.0, 0.0]), (1, 1, ["b", "c"], [0.0, 0.0])]
    assert scores(spark, rows) == pytest.approx({0: 1 / 3, 1: 1 / 3})
    matrix = {(r["i"], r["j"]): r["score"] for r in consistency.similarity_matrix(spark.createDataFrame(rows, RESPONSE)).collect()}
    assert matrix == pytest.approx({(0, 0): 2 / 3, (0, 1): 1 / 3, (1, 0): 1 / 3, (1, 1): 2 / 3})


def test_lone_and_empty_responses(spark):
    got = scores(spark, [(1, 0, ["a"], [0.0])])
    assert math.isnan(got[0])
    assert scores(spark, [(1, 0, ["a"], [0.0]), (1, 1, [], [])]) == {0: 0.0, 1: 0.0}


def test_linear_form_is_the_matrix(spark):
    rng = random.Random(2)
    rows = [(g, i, t, [-rng.random() for _ in t]) for g in range(5) for i in range(4) for t in [[rng.choice("abcdef") for _ in range(rng.randint(4, 9))]]]
    df = spark.createDataFrame(rows, RESPONSE)
    matrix = consistency.similarity_matrix(df, 2, True, True).where("i <> j").groupBy("group_id", "i").agg((F.sum("score") / 3).alias("m"))
    both = consistency.consistency_scores(df, 2, True, True).join(matrix.withColumnRenamed("i", "resp_id"), ["group_id", "resp_id"], "left").collect()
    assert len(both) == 20
    for r in both:
        assert r["score"] == pytest.approx(r["m"] or 0.0)


def test_ordering(spark):
    docs = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5)])
    got = [r["o"] for r in spark.range(3).select(consistency.alternate_ordering(docs, F.col("id")).alias("o")).collect()]
    assert got == [[1, 2, 3, 4, 5], [2, 1, 5, 4, 3], [5, 4, 3, 2, 1]]


def test_votes(spark):
    kind = "case_id int, sample int, grade struct<score:int,value:string,reasoning:string>"
    right, wrong = (1, "CORRECT", "r"), (0, "INCORRECT", "w")
    rows = [(1, i, g) for i, g in enumerate([right, wrong, right, wrong])] + [(2, i, None) for i in range(5)] + [(3, 0, None), (3, 1, right)]
    got = {r["case_id"]: tuple(r)[1:] for r in evaluation.consensus(spark.createDataFrame(rows, kind), "case_id", "sample").collect()}
    assert got == {1: (0, "INCORRECT", "w", 0.5), 2: (0, "INCORRECT", "No consensus", 0.0), 3: (1, "CORRECT", "r", 1.0)}


def test_average_precision(spark):
    rows = [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)]
    got = {r["case"]: r["ap"] for r in evaluation.average_precision(spark.createDataFrame(rows, "case int, rank int, hit boolean"), "case").collect()}
    assert got == pytest.approx({1: (1 + 2 / 3) / 2, 2: 0.0})


def test_qa_pairs(spark):
    rows = [(1, "Q: 1. Foo?\nA: bar\nbaz\n\nQ2?\n- x"), (2, "no question\nQ?\na"), (3, "Q?\n"), (4, None), (5, "A?\nb")]
    got = qa_pairs.parse_qa_pairs(spark.createDataFrame(rows, "k int, text string"), "k", 2).orderBy("k", "pair").collect()
    assert [tuple(r) for r in got] == [(1, 1, "Foo?", "bar baz"), (1, 2, "Q2?", "x")]


def test_nearest_by_blocks(spark, monkeypatch):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    expected = {(q, x) for q, v in rows[:7] for x, _ in sorted(((x, round(sum((a - b) ** 2 for a, b in zip(v, w))  , 6)) for x, w in rows), key=lambda t: (t[1], t[0]))[:3]}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    got = retrieval.nearest(df.where("id < 7"), df, 3)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == expected


def test_nearest_of_many_ties(spark):
    rows = [(f"r{i % 977:04d}-{i:04d}", [float(i * 7 % 5), float(i * 3 % 4)]) for i in range(3000)]
    gaps = [(None, [0.0, 0.0]), ("none", None), ("part", [None, 1.0])]
    corpus = spark.createDataFrame(rows + gaps, "id string, vector array<double>").repartition(2)
    queries = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.4, 1.5]), ("c", None)], "id string, vector array<double>")
    far = lambda v, w: round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 6)
    for k in (1, 10, 400):
        expected = {}
        for q, v in (("a", [0.0, 0.0]), ("b", [2.4, 1.5])):
            expected[q] = sorted((far(v, w), i) for i, w in rows)[:k]
        got = retrieval.nearest(queries, corpus, k).orderBy("query_id", "rank").collect()
        assert {q: [(r["distance"], r["id"]) for r in got if r["query_id"] == q] for q in ("a", "b")} == expected
        assert {r["query_id"] for r in got} == {"a", "b"}
    assert len(retrieval.nearest(queries, corpus.where("id = 'part'"), 5).collect()) == 2


def test_messages(spark):
    kind = "m array<struct<role:string,text:string>>"
    rows = [([("system", "s"), ("user", "u")],), ([("system", "s")],), ([("user", "u")],)]
    got = [r["x"] for r in spark.createDataFrame(rows, kind).select(chat.merge_system(F.col("m")).alias("x")).collect()]
    assert [[tuple(m) for m in x] for x in got] == [[("user", "s\n\nu")], [("user", "s")], [("user", "u")]]
    with pytest.raises(Exception, match="not the user's"):
        spark.createDataFrame([([("assistant", "a")],)], kind).select(chat.chat_prompt(F.col("m"))).collect()


def test_sampling_parameters():
    assert chat.sampling_parameters(temperature=0.2) == {"temperature": 0.2, "do_sample": True}
    assert chat.sampling_parameters(temperature=0, top_p=0.9, stop=["x"]) == {"do_sample": False, "stop": ["x"]}
    assert chat.sampling_parameters(top_k=3, do_sample=False)["do_sample"] is True


def test_answering(spark):
    docs = spark.createDataFrame([(i, f"rule {i} says move {i} steps. " * 5) for i in range(12)], "doc_id long, text string")
    embedder, model = chat.HashingEmbedder(), chat.EchoModel()
    chunks, vectors = qa.build_index(docs, "parent_document", embedder, parent_size=20, parent_overlap=2, child_size=8, child_overlap=1)
    asked = spark.createDataFrame([(1, "how far is move 3?"), (2, "what says rule 5?")], "question_id int, question string")
    for strategy in consistency.STRATEGIES:
        got = qa.answer(asked, chunks, vectors, model, embedder, qa.QaOptions(samples=2, strategy=strategy)).collect()
        assert sorted(r["question_id"] for r in got) == [1, 2] and all(r["answer"] for r in got)
    with pytest.raises(ValueError):
        consistency.check_strategy("centroid", True)
    with pytest.raises(ValueError):
        qa.build_index(docs, "other", embedder)


def test_parents(spark):
    runs = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 99)], "run_id long, parent_id long")
    got = {r["run_id"]: r["parent_ids"] for r in trace.parent_ids(runs).collect()}
    assert got[39] == list(range(39)) and got[0] == [] and got[100] == []


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.write_json_lines(rows, f"{tmp_path}/l")
    assert files.read_json_lines(spark, f"{tmp_path}/l").count() == 2
    files.write_json(rows, f"{tmp_path}/j")
    assert {r["k"] for r in files.read_json(spark, f"{tmp_path}/j").collect()} == {1, 2}
    (tmp_path / "r.txt").write_text("TITLE\n\nfirst\fsecond")
    got = files.read_elements(files.scan_files(spark, str(tmp_path), "*.txt"), files.PlainText()).orderBy("seq").collect()
    assert [(r["category"], r["page_number"], r["text"]) for r in got] == [("Title", 1, "TITLE"), ("NarrativeText", 1, "first"), ("NarrativeText", 2, "second")]


def test_stream_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = trace.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert spark.sql("select sum(n) from counts").first()[0] == events.count()
    finally:
        query.stop()


def test_stream_elapsed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:05")], "run_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/s")
    rows.withColumn("ts", F.col("ts") + F.expr("interval 7 seconds")).write.parquet(f"{tmp_path}/e")
    read = lambda p: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{p}")
    query = trace.elapsed_stream(read("s"), read("e")).writeStream.format("memory").queryName("took").start()
    try:
        query.processAllAvailable()
        assert {r["micros"] for r in spark.sql("select * from took").collect()} == {7_000_000}
    finally:
        query.stop()


def test_judging(spark):
    kind = "case_id int, query string, prediction string, true_answers array<string>, examples array<string>"
    cases = spark.createDataFrame([(1, "q", "p", ["t"], []), (2, "r", "s", ["t", "u"], ["e"])], kind)
    graded, accuracy = grading.evaluate(cases, chat.EchoModel("So it is. GRADE: CORRECT ({})"), 3)
    assert {(r["case_id"], r["score"], r["ratio_correct"]) for r in graded.collect()} == {(1, 1, 1.0), (2, 1, 1.0)}
    assert accuracy.first()["accuracy"] == 1.0
    assert [r["score"] for r in grading.judge(cases, chat.EchoModel("no idea"), 1).collect()] == [None, None]


def test_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("TITLE\n\nSome rule.\fNEXT\n\nAnother rule.")
    cli.build(spark, "parent_document", str(tmp_path / "in"), str(tmp_path / "out"))
    chunks, vectors = qa.load_index(spark, str(tmp_path / "out"))
    assert chunks.count() == 2 and vectors.count() == 2


def test_tokenizers(spark):
    row = spark.createDataFrame([("a  bc d",), (None,), ("",)], "t string")
    assert [r["x"] for r in row.select(tokenizer()(F.col("t")).alias("x")).collect()] == [["a", "bc", "d"], None, []]
    path = "/opt/tokenizers/byte_bpe_50k.json"
    got = [r["x"] for r in row.select(tokenizer(path)(F.col("t")).alias("x")).collect()]
    assert "".join(got[0]) == "a  bc d" and got[2] == []
    assert resolve_tokenizer("p", "http://x", {}) == "p" and resolve_tokenizer(None, "http://big-model", {"big": "b"}) == "b"
    with pytest.raises(ValueError):
        resolve_tokenizer(None, None, {})


def test_multi_vector_queries_are_every_hundredth_document(spark, sf_dir):
    from quire.queries import QUERIES

    assert {r["query_id"] for r in QUERIES["multi_vector_topk"](spark, sf_dir).select("query_id").collect()} == {0, 100}


def test_short_answers_are_picked_from(spark):
    rows = [(1, s, "q", a, "r", "c", a.split(), [-0.1] * len(a.split())) for s, a in enumerate(["yes", "yes", "no way at all"])] + [(2, s, "q", a, "r", "c", a.split(), [-0.1] * len(a.split())) for s, a in enumerate(["a b c", "a b d", "a b c e"])]
    df = spark.createDataFrame(rows, "question_id int, sample int, question string, answer string, cot_response string, context string, token_ids array<string>, token_logprobs array<double>")
    got = {r["question_id"]: r["answer"] for r in qa.pick(df, "bigram_consistency", None, chat.HashingEmbedder()).collect()}
    assert set(got) == {1, 2} and got[1] in ("yes", "no way at all")
    plain = qa.pick(df.drop("token_ids", "token_logprobs"), "bigram_consistency", None, chat.HashingEmbedder())
    assert plain.count() == 2


def test_methods_at_once_are_the_methods(spark):
    rng = random.Random(3)
    rows = [(g, i, w := [rng.choice("abcd") for _ in range(rng.randrange(0, 7))], [-rng.random() for _ in w]) for g in range(12) for i in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, RESPONSE)
    got = {(r["method"], r["group_id"], r["resp_id"]): r["score"] for r in consistency.scores_by_method(df).collect()}
    for name, *how in consistency.METHODS:
        for r in consistency.consistency_scores(df, *how).collect():
            assert got[name, r["group_id"], r["resp_id"]] == pytest.approx(r["score"], nan_ok=True)


def test_pairs_are_created_or_skipped(spark):
    class Writer:
        def generate(self, prompts):
            return ["Q: one?\nA: 1\nQ: two?\nA: 2\nQ: three?\nA: 3" if "good" in p else "nothing" for p in prompts]

    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "doc_id int, text string")
    got = qa_pairs.create_qa_pairs(docs, "doc_id", Writer()).collect()
    assert sorted((r["doc_id"], r["question"], r["answer"]) for r in got) == [(1, "one?", "1"), (1, "three?", "3"), (1, "two?", "2")]


def test_documents_are_added_to_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green blue " * 300), (2, "one two three " * 100)], "doc_id int, text string")
    embedder = chat.HashingEmbedder()
    qa.save_index(*qa.build_index(docs, "parent_document", embedder), str(tmp_path))
    before = qa.load_index(spark, str(tmp_path))[0].count()
    qa.add_documents(str(tmp_path), spark.createDataFrame([(3, "four five six")], "doc_id int, text string"), "parent_document", embedder)
    chunks, vectors = qa.load_index(spark, str(tmp_path))
    assert chunks.count() == before + 1 and vectors.where("parent_id = '3-0'").count() == 1
    words = chunks.select(F.size(F.split("text", " ")).alias("n")).agg(F.max("n")).first()[0]
    assert words <= 500


def test_a_chat_completions_server(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][0]["content"].upper()
            choice = {"message": {"content": text}, "logprobs": {"content": [{"token": t, "logprob": -0.5} for t in text.split()]} if body.get("logprobs") else None}
            reply = json.dumps({"choices": [choice]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = chat.ChatCompletionsModel(f"http://127.0.0.1:{server.server_port}/v1", "m", {"temperature": 0})
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id int, p string")
    assert sorted((r["id"], r["t"]) for r in rows.select("id", chat.call_model(model, F.col("p")).alias("t")).collect()) == [(1, "A B"), (2, None), (3, "C")]
    got = {r["id"]: r["d"] for r in rows.select("id", chat.call_with_details(model, F.col("p")).alias("d")).collect()}
    assert got[1]["token_ids"] == ["A", "B"] and got[1]["token_logprobs"] == [-0.5, -0.5] and got[3]["text"] == "C"
    server.shutdown()


def test_a_run_log_is_written_and_read(spark, tmp_path):
    log = trace.RunLog(str(tmp_path))
    with pytest.raises(ValueError), log.run("outer", inputs={"q": 1}) as outer:
        with log.run("inner", "llm") as inner:
            inner.outputs = "text"
        raise ValueError("no")
    rows = trace.read_log(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r["event"], r["run_name"]) for r in rows] == [("start", "outer"), ("start", "inner"), ("end", "inner"), ("error", "outer")]
    assert rows[1]["parent_ids"] == [outer.id] and rows[3]["error"] == "ValueError: no" and rows[2]["outputs"] == '"text"'
    got = trace.elapsed(trace.read_log(spark, str(tmp_path)).withColumn("ts", F.col("timestamp")))
    assert got.count() == 2


def test_a_cluster_must_name_its_folder(spark):
    from quire.plans import storage

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        storage.shared_folder(Session())
    storage.release(spark)
    kept = storage.durable(spark.range(3), "kept")
    assert kept.count() == 3 and storage.release(spark) == 1


def indexes(rows):
    """The chunk index as a loop over (part, order, source)."""
    out, last = {}, {}
    for part, order, source in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        n = last[part][1] + 1 if part in last and last[part][0] == source else 0
        out[part, order], last[part] = n, (source, n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chunk_index_goes_on_across_ranges(spark, seed):
    rng, rows = random.Random(seed), []
    for part, change in ((None, 0.3), ("a", 0.02), ("b", 0.0), ("c", 1.0)):
        source = None
        for i in range(rng.choice([1, 60, 200])):
            source = rng.choice([None, "x", "y"]) if rng.random() < change else source
            rows.append((part, i, source))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = etl.chunk_index(spark.createDataFrame(rows, "part string, o int, source string"), "o").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["part"], r["o"]): r["chunk_index"] for r in got} == indexes(rows)


def test_chunk_index_of_no_rows(spark):
    assert etl.chunk_index(spark.createDataFrame([], "part string, o int, source string"), "o").count() == 0


def test_the_first_elements_metadata_is_carried(spark):
    rows = [("a", 0, "Title", 1, "T", "en"), ("a", 1, "NarrativeText", 1, "goes", "de"), ("a", 2, "NarrativeText", 1, "on.", None), ("a", 3, "Title", 2, "U", None)]
    got = etl.elements_to_documents(spark.createDataFrame(rows, ELEMENT + ", lang string"), ["lang"])
    assert {(r["page_number"], r["text"], r["lang"]) for r in got.collect()} == {(1, "T\ngoes on.", "en"), (2, "U", None)}


def test_chunks_in_tokens_of_a_file(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    text = "\n\n".join(" ".join(f"extraordinarily{i}" for i in range(j, j + 30)) for j in range(4))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = etl.recursive_chunks(rows, 40, 5, "tokens", path).orderBy("chunk_index").collect()
    from quire.functions.tokenizers import count_tokens

    assert len(got) > 4 and {r["doc_id"] for r in got} == {1}
    assert all(count_tokens(path)(r["chunk"]) <= 44 and r["chunk"] in text for r in got)
    assert {w for r in got for w in r["chunk"].split()} == set(text.split())


def test_recursive_chunks_of_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {}
    for r in etl.recursive_chunks(docs, 1000, 200).collect():
        assert len(r["chunk"]) <= 1000 and r["chunk"] in texts[r["doc_id"]]
        words.setdefault(r["doc_id"], set()).update(r["chunk"].split())
    assert words == {d: set(t.split()) for d, t in texts.items() if t and t.strip()}


class Flaky:
    def generate(self, prompts):
        if "bad" in prompts:
            raise OSError("no reply")
        return [p + s for p in prompts for s in "12"]


def test_calls_in_batches(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", None, "bad", "c"])], "id int, p string").coalesce(1)
    got = {r["id"]: r["x"] for r in rows.select("id", chat.call_in_batches(Flaky(), F.col("p"), 2, 2, keep_errors=True).alias("x")).collect()}
    assert [got[i]["texts"] for i in range(5)] == [["a1", "a2"], ["b1", "b2"], None, None, ["c1", "c2"]]
    assert got[3]["error"] == "OSError: no reply" and got[2]["error"] is None
    with pytest.raises(Exception, match="no reply"):
        rows.select(chat.call_in_batches(Flaky(), F.col("p"), 2, 2)).collect()


class Lengths:
    def encode(self, texts, scale=1):
        return [[len(t) * scale, t.count(" ")] for t in texts]


def test_embedders(spark):
    rows = spark.createDataFrame([("a\nb",), (None,)], "t string")
    got = rows.select(chat.embed(chat.EncoderEmbedder(Lengths, 2, {"scale": 2}), F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [[6.0, 1.0], [0.0, 0.0]]


def test_served_models_and_embeddings():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from quire.functions.tokenizers import served_model

    class Handler(BaseHTTPRequestHandler):
        def reply(self, value):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            self.reply({"model_id": "org/Big-7b"})

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            self.reply([[float(len(t))] for t in texts])

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert resolve_tokenizer(None, served_model(url), {"Big": "path"}) == "path"
    assert chat.HttpEmbedder(url, 1, batch=2).embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    server.shutdown()


def test_the_command_needs_a_tokenizer_or_an_endpoint(spark, tmp_path):
    with pytest.raises(ValueError, match="tokenizer or an endpoint"):
        cli.build(spark, "parent_document", str(tmp_path), str(tmp_path / "out"), tokenizer=None)


def test_prompts_and_reports(spark):
    from quire.plans import experiments, reports

    rows = spark.createDataFrame([(1, "why?", "because", ["a", "b"], [-0.5, 0.0])], "case_id int, question string, context string, token_ids array<string>, token_logprobs array<double>")
    assert experiments.run_task(rows, chat.EchoModel("{}"), "quote").first()["said"] == "Question: why?"
    with pytest.raises(ValueError):
        experiments.run_task(rows, chat.EchoModel(), "other")
    assert [r["value"] for r in reports.token_lines(rows, "case_id").orderBy("pos").collect()] == ["| a | -0.500 | 60.65%", "| b | 0.000 | 100.00%"]
    graded = spark.createDataFrame([(1, "q\nr", "p", "CORRECT", 1.0), (2, None, "p", None, None)], "case_id int, query string, prediction string, value string, ratio_correct double")
    assert [r["value"] for r in reports.graded_lines(graded).orderBy("case_id").collect()] == ["  | 1.00 | q r | p", "? | - | - | p"]
    assert reports.html_table(spark.createDataFrame([("<a>", None)], "x string, y string")) == "<table><tr><th>x</th><th>y</th></tr><tr><td>&lt;a&gt;</td><td></td></tr></table>"
    messages = F.concat(chat.fill_messages([("system", "Be {how}.")], how=F.lit("brief")), chat.fill_messages([("user", "{question}")], question=F.col("question")))
    assert rows.select(chat.chat_prompt(messages).alias("p")).first()["p"] == "System: Be brief.\nUser: why?\nAssistant:"


def test_descriptions_windows_and_sessions(spark):
    with trace.described(spark, "outer"):
        with trace.described(spark, "inner"):
            assert spark.sparkContext.getLocalProperty("spark.job.description") == "inner"
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "outer"
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:10:00"), (1, "a", "2024-01-01 00:30:00"), (1, "a", "2024-01-01 02:00:00")], "user_id int, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n"] for r in trace.event_sessions(rows).collect()) == [1, 2]
    assert sorted(r["n"] for r in trace.event_counts(rows, "1 hour", slide="30 minutes").collect()) == [1, 1, 1, 1, 2]


def test_pdf_files_need_their_package(tmp_path):
    with pytest.raises(ImportError, match="unstructured"):
        files.OcrPdf().elements(b"%PDF")


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_eliminating_the_furthest_is_the_loop(spark):
    rng = random.Random(3)
    groups = {g: [[rng.gauss(1, 1) for _ in range(3)] for _ in range(n)] for g, n in enumerate([1, 2, 3, 6])}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    got = {r["group_id"]: r["centroid"] for r in consistency.eliminate_furthest(spark.createDataFrame(rows, "group_id int, resp_id int, vector array<double>")).collect()}
    for g, vs in groups.items():
        center = vs[0]
        while len(vs) > 2:
            center = unit([sum(x) / len(vs) for x in zip(*vs)])
            worst = min(range(len(vs)), key=lambda i: sum(a * b for a, b in zip(unit(vs[i]), center)))
            vs = vs[:worst] + vs[worst + 1 :]
        assert got[g] == pytest.approx(center)


def test_clusters_are_means_of_what_is_nearest(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 0.1) + 5 * (i % 3 == 0), rng.gauss(0, 0.1)] for i in range(90)]
    df = spark.createDataFrame([(i % 4, i, v) for i, v in enumerate(vectors)], "group_id int, resp_id int, vector array<double>")
    found = consistency.cluster_centroids(df).collect()
    assert [r["size"] for r in found] == [30, 60]
    for r, near in zip(found, (True, False), strict=True):
        own = [v for i, v in enumerate(vectors) if (i % 3 == 0) == near]
        assert r["centroid"] == pytest.approx([sum(x) / len(own) for x in zip(*own)], abs=1e-6)
    scores = {r["resp_id"]: r["score"] for r in consistency.largest_cluster_similarity(df).collect()}
    center = unit(found[1]["centroid"])
    assert scores == pytest.approx({i: sum(a * b for a, b in zip(unit(v), center)) for i, v in enumerate(vectors)})


def test_documents_by_several_vectors_are_those_of_all_distances(spark, sf_dir):
    from quire.queries import QUERIES

    embedder = chat.HashingEmbedder()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    index = qa.build_index(docs, "hypothetical_queries", embedder, model=chat.EchoModel("Q1: {}"), parent_size=200, parent_overlap=20)[1].collect()
    want = {}
    for r in docs.where("doc_id % 100 = 0").collect():
        query = embedder.embed([r["text"]])[0]
        near = sorted(((round(max(sum((a - b) ** 2 for a, b in zip(query, x["vector"])), 0), 6), x["id"], x["parent_id"]) for x in index))[:10]
        want[r["doc_id"]] = list(dict.fromkeys(p for _, _, p in near))
    got = {}
    for r in QUERIES["multi_vector_topk"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["parent_id"])
    assert got == want


def test_an_index_is_made_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(5)
    for table in qa.build_index(docs, "parent_document", chat.HashingEmbedder()):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "Python" not in plan


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e8, 1e12])
def test_pairs_left_out_are_no_neighbours(scale):
    import numpy as np

    from quire.operators import retrieval

    rng = np.random.default_rng(5)
    rows, asked, k, best = scale * rng.normal(size=(6000, 8)), scale * rng.normal(size=(50, 8)), 7, None
    rows[3000:3100], rows[5000] = rows[0], np.nan
    names = np.array([f"r{i:05}" for i in rng.permutation(len(rows))], object)
    for i in range(0, len(rows), 500):
        order = np.argsort(names[i : i + 500])
        best = retrieval._nearer(asked, rows[i : i + 500][order], names[i : i + 500][order], best, k)
    for q, dist, found in zip(asked, *best, strict=True):
        d = np.nan_to_num(np.round(((rows - q) ** 2).sum(1), 6), nan=np.inf)
        want = sorted(zip(d, names))[:k]
        if scale <= 1:
            assert list(found) == [n for _, n in want]
        assert dist == pytest.approx([x for x, _ in want], rel=1e-9, abs=1e-6)


def test_the_length_of_a_vector_is_worked_out_once(spark):
    from quire.functions.vectors import normalized

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(normalized(F.col("v")).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 1


def test_more_ngrams_are_more_parts(spark, monkeypatch):
    rows = [(g, i, t, [-0.1 * j for j in range(len(t))]) for g in range(4) for i, t in enumerate([["1:a", "b"], ["1", ":a", "b", "b"], [], ["b", "1:a", "1:a"]])]
    df = spark.createDataFrame(rows, RESPONSE)
    want = {(r["group_id"], r["resp_id"]): r["score"] for r in consistency.consistency_scores(df, 2, True, True).collect()}
    assert consistency._dealt(df, 2)[1] == 1
    monkeypatch.setattr(consistency, "TASK_NGRAMS", 9)
    dealt, parts = consistency._dealt(df, 2)
    assert dealt.rdd.getNumPartitions() == parts == 8
    assert {(r["group_id"], r["resp_id"]): r["score"] for r in consistency.consistency_scores(df, 2, True, True).collect()} == pytest.approx(want, nan_ok=True)
    every = [{(*t[j : j + k],) for t in ([x[2] for x in rows if x[0] == 0]) for k in (1, 2) for j in range(len(t) - k + 1)}]
    assert {r["group_id"]: r["vocabulary"] for r in consistency.vocabulary_sizes(df, 2).collect()} == {g: len(every[0]) for g in range(4)}


def test_small_groups_are_one_tasks_and_large_ones_are_dealt(spark, monkeypatch):
    rows = [(g, i, t * (3 if g == 2 else 1), [-0.1 * (j % 4) for j in range(len(t) * (3 if g == 2 else 1))]) for g in (0, 1, 2, 3, None) for i, t in enumerate([["1:a", "b", "c", "d"], ["b", "c", "e", "f"], ["g", "b", "h"]])]
    df = spark.createDataFrame(rows, RESPONSE)
    score = lambda: {(r["group_id"], r["resp_id"]): r["score"] for r in consistency.consistency_scores(df, 2, True, True).collect()}
    want, sizes = score(), {r["group_id"]: r["vocabulary"] for r in consistency.vocabulary_sizes(df, 2).collect()}
    assert {g for g, _ in want} == {0, 1, 2, 3}  # answers without a group are in none
    monkeypatch.setattr(consistency, "TASK_NGRAMS", 9)
    monkeypatch.setattr(consistency, "GROUP_NGRAMS", 30)
    dealt, parts = consistency._dealt(df, 2)
    grams = consistency._by_ngram(consistency._own_ngrams(dealt, 2, True, "shards"), parts).withColumn("task", F.spark_partition_id())
    tasks = {r["group_id"]: r["n"] for r in grams.groupBy("group_id").agg(F.count_distinct("task").alias("n")).collect()}
    assert parts > 8 and tasks[0] == tasks[1] == tasks[3] == 1 and tasks[2] > 1
    assert score() == pytest.approx(want)
    assert {r["group_id"]: r["vocabulary"] for r in consistency.vocabulary_sizes(df, 2).collect()} == sizes


def test_ngrams_of_a_long_answer_are_told_apart_in_linear_time(spark):
    """Comparing all n-grams of this answer with all takes some 10^10 steps."""
    import time

    words = [f"w{i}" for i in range(100_000)]
    df = spark.createDataFrame([(0, 0, words, [0.0] * len(words)), (0, 1, words[:10] * 2, [0.0] * 20)], RESPONSE)
    began = time.perf_counter()
    assert consistency.vocabulary_sizes(df, 2).first()["vocabulary"] == 200_000
    assert time.perf_counter() - began < 60
