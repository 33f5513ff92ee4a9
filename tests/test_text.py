import pytest
from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "expected"), [
    ("ok GRADE: CORRECT", (1, "CORRECT", "ok")), ("GRADE: CORRECT", (1, "CORRECT", "GRADE: CORRECT")), ("GRADE: CORRECT\ndone", None), ("  ok GRADE: CORRECT", (1, "CORRECT", "o")),
    ("so grade: incorrect and GRADE: CORRECT", (0, "INCORRECT", "so")), ("Well. GRADE: CORRECTLY", (1, "CORRECT", "Well.")), ("Correct, I say", (1, "CORRECT", "Correct, I say")),
    ("it is *incorrect*.", (0, "INCORRECT", "it is *incorrect*.")), ("", None), (None, None), ("neither", None),
])
def test_grade(spark, text, expected):
    got = one(spark, text, T.grade)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(("text", "expected"), [("Q: 1. Foo?", "Foo?"), ("1.", "1."), ("- answer: x", "answer: x"), ("Question: - 2. y ", "y"), ("", ""), (None, None), ("A: Q: z", "Q: z")])
def test_strip_qa_prefix(spark, text, expected):
    assert one(spark, text, T.strip_qa_prefix) == expected


@pytest.mark.parametrize(("text", "expected"), [("Answer: yes ", "yes"), ("> answer: A: no", "A: no"), (" Answer: x", " Answer: x"), ("a:b", "b"), (None, None)])
def test_remove_answer_prefix(spark, text, expected):
    assert one(spark, text, T.remove_answer_prefix) == expected


def test_parse_questions(spark):
    assert one(spark, "x\nQ1: a  b?\n 2. no\n3. 4: c\n5. ", T.parse_questions) == ["a b?", "c", ""]


@pytest.mark.parametrize(("text", "expected"), [("Ends. ", True), ("(so?)", True), ("no", False), ("dots...", True), ("a.)\n", True), (None, None)])
def test_sentence_end(spark, text, expected):
    assert one(spark, text, T.has_sentence_end) == expected


@pytest.mark.parametrize(("text", "expected"), [
    ("The most consistent response is Response 2", 2), ("x\nThe most consistent response is Response 1. The most consistent response is Response 3", 3), ("none", None),
])
def test_chosen_index(spark, text, expected):
    assert one(spark, text, T.chosen_index) == expected
    got = spark.createDataFrame([(["a", "b"], expected)], "r array<string>, i int").select(T.choose("r", F.col("i")).alias("x")).first()["x"]
    assert got == "a"


def test_stops(spark):
    assert one(spark, "one STOP two END", lambda c: T.truncate_at_stops(c, ["END", "STOP"])) == "one "
