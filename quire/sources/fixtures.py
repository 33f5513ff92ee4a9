"""Inputs of the registered queries, derived from the test tables alike in DataFrame operations and in SQL.

Each has a function (spark, sf_dir) -> DataFrame and the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Assistant turns as sampled answers of their conversation, with made log probabilities; groups of at least two."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    out = turns.select(
        F.col("conv_id").alias("group_id"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("resp_id"), "text", F.split(F.trim("text"), r"\s+").alias("tokens")
    )
    out = out.withColumn("logprobs", F.transform("tokens", lambda t: -(F.length(t) % 5) / F.lit(10.0)))
    sizes = W.partitionBy("group_id")
    return out.withColumn("_n", F.count("*").over(sizes)).where(F.col("_n") >= least).drop("_n")


RESPONSES = r"""
responses0 AS (
  SELECT conv_id AS group_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS resp_id, text, string_split_regex(trim(text), '\s+') AS tokens
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
responses AS (
  SELECT * FROM (
    SELECT *, list_transform(tokens, lambda t: -(length(t) % 5) / 10.0::DOUBLE) AS logprobs, count(*) OVER (PARTITION BY group_id) AS n
    FROM responses0) WHERE n >= 2)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with good and bad answers: (group_id, responses, good, bad); every fifth answer has no label, and at least two of a case have one."""
    rows = responses(spark, sf_dir)
    place = lambda ok: F.array_sort(F.collect_list(F.when((F.col("resp_id") % 5 != 4) & ok, F.col("resp_id"))))
    good, said = F.length("text") % 3 != 0, F.struct("text", "tokens", "logprobs")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("resp_id", said.alias("r")))), lambda x: x["r"])
    got = rows.groupBy("group_id").agg(ordered.alias("responses"), place(good).alias("good"), place(~good).alias("bad"))
    return got.where(F.size("good") + F.size("bad") >= 2)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as page elements: every fifth a title, short ones list items; some lose their full stop."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    cut = ((F.col("doc_id") + F.col("seq")) % 3 == 0) & F.col("line").endswith(".")
    return lines.select(
        F.col("doc_id").cast("string").alias("source"), "seq",
        F.when(F.col("seq") % 5 == 0, "Title").when(F.length("line") < 40, "ListItem").otherwise("NarrativeText").alias("category"),
        (F.floor(F.col("seq") / 4) % 3 + 1).cast("int").alias("page_number"),
        F.when(cut, F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line")).alias("text"),
    )


ELEMENTS = r"""
lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS seq, l[i] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
elements AS (
  SELECT CAST(doc_id AS VARCHAR) AS source, seq,
         CASE WHEN seq % 5 = 0 THEN 'Title' WHEN length(line) < 40 THEN 'ListItem' ELSE 'NarrativeText' END AS category,
         CAST(seq // 4 % 3 + 1 AS INT) AS page_number,
         CASE WHEN (doc_id + seq) % 3 = 0 AND suffix(line, '.') THEN line[1:length(line) - 1] ELSE line END AS text
  FROM lines)"""


LABELLED = RESPONSES.replace("responses AS (", "every_response AS (") + r""",
responses AS (
  SELECT * FROM (
    SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY length(text) % 3 = 0, resp_id) - 1 AS INT) AS resp_id, text, tokens, logprobs, length(text) % 3 <> 0 AS hit, count(*) OVER (PARTITION BY group_id) AS n
    FROM every_response WHERE resp_id % 5 <> 4) WHERE n >= 2)"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five judges' texts on each labelled document, in six shapes."""
    rows = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4))))
    right = F.when(F.col("quality") == 1, (F.col("doc_id") * 7 + F.col("sample") * 3) % 10 < 7).otherwise((F.col("doc_id") * 7 + F.col("sample") * 3) % 10 < 2)
    v, shape = F.when(right, "CORRECT").otherwise("INCORRECT"), (F.col("doc_id") + F.col("sample")) % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("The answer names the rule. GRADE: "), v)).when(shape == 1, F.concat(v, F.lit(". It fits the rule.")))
        .when(shape == 2, F.concat(F.lit("The verdict, grade: "), F.lower(v), F.lit(" as seen"))).when(shape == 3, F.concat(F.lit("GRADE: "), v))
        .when(shape == 4, F.lit("No verdict is given here")).otherwise(F.concat(F.lit("  ok GRADE: "), v))
    )
    return rows.select(F.col("doc_id").alias("case_id"), "sample", "quality", text.alias("text"))


GRADES = r"""
verdicts AS (
  SELECT doc_id, CAST(s AS INT) AS sample, quality, (doc_id + s) % 6 AS shape,
         CASE WHEN (doc_id * 7 + s * 3) % 10 < CASE WHEN quality = 1 THEN 7 ELSE 2 END THEN 'CORRECT' ELSE 'INCORRECT' END AS v
  FROM labels, range(5) t(s) WHERE doc_id IS NOT NULL AND quality IS NOT NULL),
grades AS (
  SELECT doc_id AS case_id, sample, quality,
         CASE shape WHEN 0 THEN 'The answer names the rule. GRADE: ' || v WHEN 1 THEN v || '. It fits the rule.' WHEN 2 THEN 'The verdict, grade: ' || lower(v) || ' as seen'
                    WHEN 3 THEN 'GRADE: ' || v WHEN 4 THEN 'No verdict is given here' ELSE '  ok GRADE: ' || v END AS text
  FROM verdicts),
marked AS (
  SELECT *, upper(regexp_extract(substr(trim(text), 3), '(?i)GRADE:\s*(CORRECT|INCORRECT)', 1)) AS mark,
         length(regexp_extract(substr(trim(text), 3), '(?is)^(.*?)GRADE:\s*(?:CORRECT|INCORRECT)', 1)) + 2 AS cut,
         [regexp_replace(x, '[^A-Z]', '', 'g') FOR x IN string_split_regex(upper(trim(text)), '\s+')] AS w
  FROM grades),
parsed AS (
  SELECT case_id, sample, quality, value, CASE value WHEN 'CORRECT' THEN 1 WHEN 'INCORRECT' THEN 0 END AS score,
         CASE WHEN value IS NULL THEN NULL WHEN mark <> '' THEN trim(text[1:cut]) ELSE text END AS reasoning
  FROM (SELECT *, CASE WHEN mark <> '' THEN mark WHEN w[1] = 'CORRECT' OR w[-1] = 'CORRECT' THEN 'CORRECT' WHEN w[1] = 'INCORRECT' OR w[-1] = 'INCORRECT' THEN 'INCORRECT' END AS value FROM marked))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id, resp_id, vector): embeddings, grouped by label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group_id"), F.col("vec_id").alias("resp_id"), F.col("embedding").alias("vector"))


def qa_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer texts made of documents; every fourth has no answer to its second question."""
    w = F.split(F.trim(F.translate("text", "?", "")), r"\s+")
    head, tail = F.concat(F.lit("x"), F.array_join(F.slice(w, 1, 3), " ")), F.concat(F.lit("x"), F.array_join(F.slice(w, 4, 1 << 30), " "))
    second = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\n- "), tail))
    text = F.concat(F.lit("Q: 1. "), head, F.lit("?\nA: "), tail, F.lit("\nanswer: "), head, F.lit("\n\nQ2: "), tail, F.lit("?"), second)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("text"))


QA_TEXTS = r"""
qa_words AS (SELECT doc_id, 'x' || array_to_string(w[1:3], ' ') AS head, 'x' || array_to_string(w[4:], ' ') AS tail FROM (SELECT doc_id, string_split_regex(trim(replace(text, '?', '')), '\s+') AS w FROM documents WHERE text IS NOT NULL)),
qa_texts AS (
  SELECT doc_id, 'Q: 1. ' || head || '?' || chr(10) || 'A: ' || tail || chr(10) || 'answer: ' || head
         || chr(10) || chr(10) || 'Q2: ' || tail || '?' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || '- ' || tail END AS text
  FROM qa_words)"""
