"""The question-answering chain by stand-ins that show what they were asked, its log, and saved indexes."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.operators import chat
from quire.plans import qa
from quire.streaming import trace

DOCS = [(1, "aaa\nmore"), (2, "aab"), (3, "abb"), (4, "bbb"), (5, "aaaa no"), (6, "zzz")]


def judged(line):
    return "No." if line.endswith("no") else "yes"


def voice(name):
    return chat.QuotingModel((("Is this of use", judged), ("Say this", f"{name}> {{}}".format), ("Extract", f"{name}< {{}}".format), ("Use the rules", str), ("Go through", f"{name}~ {{}}".format)))


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return qa.build_index(docs, "parent_document", chat.LetterEmbedder("abz"), parent_size=1000, parent_overlap=0, child_size=0)


def ask(spark, index, log=None, sampling=None, **options):
    asked = spark.createDataFrame([(1, "a?"), (2, "b?")], "question_id long, question string")
    got = qa.answer(asked, *index, voice("m"), chat.LetterEmbedder("abz"), qa.QaOptions(**options), k=4, sampling=sampling, log=log)
    return {r.question_id: r.answer for r in got.collect()}


def test_the_order_of_the_chain(spark, index):
    """The nearest kept document is said anew, and what comes of that is cut down."""
    assert ask(spark, index, self_consistency=False) == {1: "m> aaa", 2: "m> bbb"}
    assert ask(spark, index, self_consistency=False, compress=True) == {1: "m< m> aaa", 2: "m< m> bbb"}
    assert ask(spark, index, self_consistency=False, reword=False, compress=True) == {1: "aaa", 2: "bbb"}
    assert ask(spark, index, self_consistency=False, thread_of_thought=True)[1] == "m~ m> aaa"


def test_the_limit_comes_before_the_filter(spark, index):
    # the texts nearest to a are "aaa" and "aaaa no", of which the filter drops the second
    assert ask(spark, index, self_consistency=False, reword=False, limit=1) == {1: "aaa", 2: "bbb"}
    assert ask(spark, index, self_consistency=False, reword=False, llm_filter=False, limit=None)[1] == "aaa"


def test_samples_are_worded_by_the_sampling_model(spark, index):
    got = ask(spark, index, samples=1, compress=True, sampling=voice("s"))
    assert got == {1: "s< s> aaa", 2: "s< s> bbb"}
    # without samples the model itself rewords, though the other one reasons
    assert ask(spark, index, self_consistency=False, sampling=voice("s"))[1] == "m> aaa"


def test_no_document_is_kept(spark, index):
    none = chat.QuotingModel((("Is this of use", lambda line: "no"), ("Use the rules", str)))
    asked = spark.createDataFrame([(1, "a?")], "question_id long, question string")
    got = qa.answer(asked, *index, none, chat.LetterEmbedder("abz"), qa.QaOptions(samples=3), k=4).collect()
    assert [(r.question_id, r.answer) for r in got] == [(1, "")]


def test_steps_are_logged(spark, index, tmp_path):
    ask(spark, index, log=trace.RunLog(str(tmp_path)), samples=3, compress=True)
    rows = trace.read_log(spark, str(tmp_path)).collect()
    starts = [r.run_name for r in rows if r.event == "start"]
    assert starts == ["answer", "retrieve", "filter", "reword", "extract", "reason", "pick"]
    whole = next(r for r in rows if r.event == "start" and r.run_name == "answer")
    assert all(r.parent_ids == [whole.run_id] for r in rows if r.run_name != "answer") and json.loads(whole.inputs)["samples"] == 3
    assert {r.run_name for r in rows if r.event == "end"} == set(starts) and all(float(r.elapsed) >= 0 for r in rows if r.event == "end")


def test_a_failing_step_is_logged(spark, index, tmp_path):
    class Broken:
        def generate(self, prompts):
            raise RuntimeError("down")

    asked = spark.createDataFrame([(1, "a?")], "question_id long, question string")
    with pytest.raises(Exception, match="down"):
        qa.answer(asked, *index, Broken(), chat.LetterEmbedder("abz"), log=trace.RunLog(str(tmp_path))).collect()
    assert {(r.run_name, r.event) for r in trace.read_log(spark, str(tmp_path)).where("event = 'error'").collect()} == {("filter", "error"), ("answer", "error")}


def test_a_document_is_not_added_twice(spark, tmp_path):
    docs, embedder = spark.createDataFrame(DOCS, "doc_id long, text string"), chat.LetterEmbedder("abz")
    qa.save_index(*qa.build_index(docs.where("doc_id < 4"), "parent_document", embedder), str(tmp_path), k=2)
    qa.add_documents(str(tmp_path), docs.where("doc_id = 4"), "parent_document", embedder)
    with pytest.raises(ValueError, match="already"):
        qa.add_documents(str(tmp_path), docs.where("doc_id in (4, 5)"), "parent_document", embedder)
    found = qa.load_retriever(spark, str(tmp_path))
    assert found.kind == "parent_document" and found.k == 2 and found.chunks.count() == found.vectors.count() == 4
    asked = spark.createDataFrame([(7, "bb")], "question_id long, question string")
    assert [tuple(r) for r in found.find(asked, embedder).collect()] == [(7, ["bbb", "abb"])]


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.reply({"model_id": "org/Word_bpe_49k-chat"})

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            self.reply([[float(len(t)), 1.0, 0.0] for t in texts])

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_the_command_with_servers(spark, tmp_path, server):
    """The tokenizer of the model that is served, vectors of an embedding server, and k."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("TITLE\n\nSome rule.\fNEXT\n\nAnother rule.")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/Word_bpe.json").symlink_to("/opt/tokenizers/word_bpe_49k.json")
    cli.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--endpoint", server, "--tokenizers", str(tmp_path / "t"), "--embedder", server, "--k", "3"])
    found = qa.load_retriever(spark, str(tmp_path / "out"))
    assert found.k == 3 and found.chunks.count() == 2 and {r.n for r in found.vectors.select(F.size("vector").alias("n")).collect()} == {3}
    with pytest.raises(ValueError, match="no tokenizer is known"):
        cli.build(spark, "parent_document", str(tmp_path / "in"), str(tmp_path / "o"), endpoint=server, tokenizer=None)
    assert list(cli.known_tokenizers(str(tmp_path / "t"))) == ["Word_bpe"] and cli.known_tokenizers(None) == {}


def test_a_prompt_is_asked_once(spark, tmp_path):
    """Though an answer's prefix is sought in many ways; and missing prompts are not asked."""
    folder = str(tmp_path)

    class Counting:
        def generate(self, prompts):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("x" * len(prompts))
            return [f"Answer: {len(p)}" for p in prompts]

    rows = spark.createDataFrame([(i, None if i == 3 else "q" * i, ["d"]) for i in range(5)], "question_id int, question string, documents array<string>")
    got = {r.question_id: r.answer for r in chat.answer_questions(rows, Counting()).collect()}
    assert got[3] is None and len({got[0], got[1], got[2], got[4]}) > 1 and all(a.isdigit() for i, a in got.items() if i != 3)
    assert sum(len(p.read_text()) for p in tmp_path.iterdir()) == 8


def test_as_many_vectors_are_sought_as_chunks_need(spark, monkeypatch):
    """With one vector a chunk the first five chunks are the five nearest; with several, more are needed, and no more than k."""
    from quire.operators import retrieval

    sought, find = [], retrieval.nearest
    monkeypatch.setattr(retrieval, "nearest", lambda q, c, k=10: sought.append(k) or find(q, c, k))
    asked = spark.createDataFrame([(1, "a?")], "question_id long, question string")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(12)], "chunk_id string, text string")
    embedder, model, options = chat.LetterEmbedder("ab"), chat.EchoModel("{}"), qa.QaOptions(self_consistency=False, llm_filter=False, reword=False, limit=3)
    for n, k, want in ((1, 20, 3), (4, 20, 9), (4, 6, 6)):
        # the nearest chunks have n vectors each, which all come before those of the next chunk
        vectors = spark.createDataFrame([(f"v{i:02}-{j}", f"c{i}", [1.0, 0.01 * i + 0.001 * j]) for i in range(12) for j in range(n)], "id string, parent_id string, vector array<double>")
        found = qa.answer(asked, chunks, vectors, model, embedder, options, k=k)
        assert sought.pop() == want
        whole = retrieval.ranked_contexts(retrieval.parent_documents(asked.select(F.col("question_id").alias("id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")), vectors, k), chunks, "chunk_id", 3)
        assert found.count() == 1 and [r.documents for r in whole.collect()] == [["text 0", "text 1", "text 2"][: 3 if k > 6 or n == 1 else 2]]


def test_letters_are_counted():
    for letters in ("abcz", "a\n", "a\u00e9"):
        for text in ("", "abba z\n", "a\u00e9\U0001f600b"):
            assert chat.LetterEmbedder(letters).embed([text]) == [[float(text.count(c)) for c in letters]]


def test_a_text_that_fits_is_one_chunk():
    import random

    from quire.operators import etl

    rnd, whole = random.Random(4), 0
    for _ in range(5000):
        text = "".join(rnd.choice("ab \n\n\t\xa0") for _ in range(rnd.randrange(1, 14)))
        for length in (len, etl.count_tokens(None)):
            if (got := etl._uncut(text, 12)) is not None:
                whole += 1
                assert got == etl.split_recursively(text, 12, 3, length), text
    assert 5000 < whole < 10000
