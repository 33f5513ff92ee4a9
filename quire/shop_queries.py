"""Queries over the event log and the shop's tables: joins on time, typed metadata, grouping sets, sketches, clusters, multisets and table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import table_functions
from quire.operators import clusters, consistency, etl, evaluation, joins, sketches
from quire.registry import query
from quire.sources import fixtures as X
from quire.sources.fixtures import table
from quire.streaming import trace


def _rounded(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# Clusters of the answers of one question

ROUNDS = 10


def _cluster_sql() -> str:
    """k-means with two clusters within each label: seeds by md5, then the furthest; a fixed number of rounds."""
    d = lambda c: f"round(list_sum([(v[i] - {c}[i]) ** 2 FOR i IN range(1, len(v) + 1)]), 9)"
    parts = [
        "vec AS MATERIALIZED (SELECT label AS g, vec_id AS r, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)",
        "s0 AS MATERIALIZED (SELECT g, arg_min(v, (md5(CAST(r AS VARCHAR)), r)) AS a FROM vec GROUP BY g)",
        f"c0 AS MATERIALIZED (SELECT g, any_value(a) AS a, arg_min(v, (-{d('a')}, r)) AS b FROM vec JOIN s0 USING (g) GROUP BY g)",
    ]
    placed = lambda i: f"SELECT g, r, v, CASE WHEN {d('b')} < {d('a')} THEN 1 ELSE 0 END AS c FROM vec JOIN c{i} USING (g)"
    for i in range(ROUNDS):
        parts += [
            f"p{i} AS MATERIALIZED ({placed(i)})",
            f"m{i} AS MATERIALIZED (SELECT g, c, list(x ORDER BY i) AS m FROM (SELECT g, c, i, avg(v[i]) AS x FROM p{i}, range(1, 65) t(i) GROUP BY g, c, i) GROUP BY g, c)",
            f"c{i + 1} AS MATERIALIZED (SELECT k.g, coalesce(any_value(m) FILTER (c = 0), any_value(a)) AS a, coalesce(any_value(m) FILTER (c = 1), any_value(b)) AS b FROM c{i} k LEFT JOIN m{i} m ON m.g = k.g GROUP BY k.g)",
        ]
    parts += [
        f"placed AS MATERIALIZED ({placed(ROUNDS)})",
        f"sized AS (SELECT g, c, count(*) AS size FROM placed GROUP BY g, c)",
        f"named AS MATERIALIZED (SELECT g, s.c, size, CASE WHEN s.c = 0 THEN a ELSE b END AS centroid, CAST(row_number() OVER (PARTITION BY g ORDER BY size, s.c) - 1 AS INT) AS cluster FROM sized s JOIN c{ROUNDS} USING (g))",
        "largest AS MATERIALIZED (SELECT g, arg_max(centroid, (size, -c)) AS centroid FROM named GROUP BY g)",
    ]
    return "WITH " + ",\n".join(parts)


@query(_cluster_sql() + " SELECT g AS group_id, cluster, size, CAST(i - 1 AS INT) AS pos, round(centroid[i], 6) AS x FROM named, range(1, 65) t(i)")
def answer_clusters(spark, sf_dir):
    """Two clusters within each label's vectors: sizes and centroids."""
    found = clusters.answer_clusters(X.vectors(spark, sf_dir), 2, ROUNDS)
    return found.select("group_id", "cluster", "size", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(_cluster_sql() + """ SELECT group_id, resp_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, resp_id DESC) AS INT) AS rank
FROM (SELECT g AS group_id, r AS resp_id, round(list_cosine_similarity(v, centroid), 9) AS score FROM vec JOIN largest USING (g))""")
def largest_cluster_rank(spark, sf_dir):
    """Vectors by cosine to the centroid of the largest cluster of their own label."""
    return clusters.largest_cluster_rank(X.vectors(spark, sf_dir), 2, ROUNDS).withColumn("score", F.round("score", 6))


# Joins on time


@query("""WITH last_sales AS (SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY client_id, sold_at)
SELECT c.click_id, c.ts, c.kind, s.sale_id FROM clicks c ASOF LEFT JOIN last_sales s ON c.client_id = s.client_id AND c.ts >= s.sold_at""")
def last_sale_before(spark, sf_dir):
    """Each click with the last sale of its client at or before it."""
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales").select("client_id", "sold_at", "sale_id")
    return joins.as_of(clicks, sales, "client_id", "ts", "sold_at", ["sale_id"]).select("click_id", "ts", "kind", "sale_id")


@query("""WITH r AS (SELECT event_id, user_id, ts, event_type FROM events), s AS (SELECT user_id, ts AS error_at, max(event_id) AS error_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts)
SELECT r.event_id, CASE WHEN r.ts - s.error_at <= INTERVAL 6 HOUR THEN s.error_id END AS error_id FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.ts >= s.error_at""")
def last_error_before(spark, sf_dir):
    """Each event with the last error of its user within six hours before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_at"), F.col("event_id").alias("error_id"))
    return joins.as_of(events, errors, "user_id", "ts", "error_at", ["error_id"], most="6 hours").select("event_id", "error_id")


@query("""SELECT s.sale_id, count(*) AS clicks, min(c.ts) AS first_click, round(sum(c.value), 6) AS value FROM sales s JOIN clicks c ON c.client_id = s.client_id AND c.ts BETWEEN s.sold_at - INTERVAL 6 HOUR AND s.sold_at GROUP BY s.sale_id""")
def clicks_before_sales(spark, sf_dir):
    """Clicks of a client within the six hours before each of its sales."""
    sales = table(spark, sf_dir, "sales").select("client_id", "sale_id", "sold_at", (F.col("sold_at") - F.expr("interval 6 hours")).alias("opened_at"))
    clicks = table(spark, sf_dir, "clicks").select("client_id", "ts", "value")
    met = joins.intervals_meet(sales, clicks, "client_id", ("opened_at", "sold_at"), ("ts", "ts"))
    return met.groupBy("sale_id").agg(F.count("*").alias("clicks"), F.min("ts").alias("first_click"), _rounded(F.sum("value"), "value"))


_RUNS = """runs AS (SELECT user_id, user_id * 1000 + event_id % 4 AS run_id, min(ts) AS began, max(ts) AS ended FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_RUNS} SELECT a.run_id, b.run_id AS other_id, greatest(a.began, b.began) AS both_from FROM runs a JOIN runs b ON a.user_id = b.user_id AND a.run_id < b.run_id AND a.began <= b.ended AND b.began <= a.ended""")
def overlapping_runs(spark, sf_dir):
    """Runs of a user that overlap in time."""
    events = table(spark, sf_dir, "events").where("user_id is not null")
    runs = events.groupBy("user_id", (F.col("user_id") * 1000 + F.col("event_id") % 4).alias("run_id")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    others = runs.withColumnsRenamed({"run_id": "other_id", "began": "other_began", "ended": "other_ended"})
    met = joins.intervals_meet(runs, others, "user_id", ("began", "ended"), ("other_began", "other_ended")).where("run_id < other_id")
    return met.select("run_id", "other_id", F.greatest("began", "other_began").alias("both_from"))


# Metadata that keeps its types


@query("""SELECT click_id, ts, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.device.os') AS os, CASE WHEN json_type(props, '$.tags') = 'ARRAY' THEN CAST(json_array_length(props, '$.tags') AS INT) END AS tags,
round(list_sum(CAST(json_extract(props, '$.items[*].qty') AS DOUBLE[])), 6) AS quantity FROM clicks WHERE json_valid(props)""")
def click_payloads(spark, sf_dir):
    """Values of the clicks' payloads, each of its own type; payloads that are no JSON are left out."""
    rows = table(spark, sf_dir, "clicks").where(F.try_parse_json("props").isNotNull())
    rows = etl.typed_metadata(rows.select("click_id", "ts", "props"), "props")
    value = lambda path, kind: etl.metadata_value("props", path, kind)
    quantities = F.transform(value("$.items", "array<variant>"), lambda x: F.try_variant_get(x, "$.qty", "double"))
    total = F.aggregate(F.filter(quantities, lambda x: x.isNotNull()), F.lit(None).cast("double"), lambda s, x: F.coalesce(s, F.lit(0.0)) + x)
    return rows.select("click_id", "ts", value("$.k", "bigint").alias("k"), value("$.device.os", "string").alias("os"), F.size(value("$.tags", "array<variant>")).alias("tags"), _rounded(total, "quantity"))


@query("""SELECT event_id, 'k:bigint=' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || ';user:bigint=' || CAST(user_id AS VARCHAR) || ';kind:string=' || event_type || ';none:void=None' AS metadata FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND json_valid(props)""")
def event_metadata(spark, sf_dir):
    """Primitive values of metadata with their types: numbers stay numbers, null is the text None, a missing key is left out."""
    rows = table(spark, sf_dir, "events").where("event_type is not null and user_id is not null").where(F.try_parse_json("props").isNotNull())
    made = F.format_string('{"k": %d, "user": %d, "kind": "%s", "none": null}', F.get_json_object("props", "$.k").cast("long"), "user_id", "event_type")
    rows = etl.typed_metadata(rows.select("event_id", made.alias("metadata")))
    said = F.transform(etl.metadata_primitives("metadata", ["k", "user", "kind", "none", "missing"]), lambda x: F.concat(x["key"], F.lit(":"), x["kind"], F.lit("="), x["value"]))
    return rows.select("event_id", F.array_join(said, ";").alias("metadata"))


# Grouping sets


@query("""WITH runs AS (SELECT doc_id % 4 AS parent_chunk_size, doc_id % 3 AS parent_chunk_overlap, doc_id % 5 AS child_chunk_size, doc_id % 2 AS child_chunk_overlap, doc_id % 6 AS number_of_docs, (doc_id % 20) / 20.0::DOUBLE AS score FROM documents),
g AS (SELECT parent_chunk_size a, parent_chunk_overlap b, child_chunk_size c, child_chunk_overlap d, number_of_docs e, GROUPING_ID(parent_chunk_size, parent_chunk_overlap, child_chunk_size, child_chunk_overlap, number_of_docs) AS s, count(*) AS runs, avg(score) AS mean
  FROM runs GROUP BY GROUPING SETS ((parent_chunk_size), (parent_chunk_overlap), (child_chunk_size), (child_chunk_overlap), (number_of_docs), ()))
SELECT CASE s WHEN 15 THEN 'parent_chunk_size' WHEN 23 THEN 'parent_chunk_overlap' WHEN 27 THEN 'child_chunk_size' WHEN 29 THEN 'child_chunk_overlap' WHEN 30 THEN 'number_of_docs' ELSE 'all' END AS parameter,
  CAST(CASE s WHEN 15 THEN a WHEN 23 THEN b WHEN 27 THEN c WHEN 29 THEN d WHEN 30 THEN e END AS VARCHAR) AS value, runs, round(mean, 6) AS mean_score FROM g""")
def grid_marginals(spark, sf_dir):
    """Mean scores of a grid of settings at each value of each parameter, from log lines."""
    d = F.col("doc_id")
    line = F.format_string('[%s, {"parent_chunk_size": %d, "parent_chunk_overlap": %d, "child_chunk_size": %d, "child_chunk_overlap": %d, "number_of_docs": %d}]', ((d % 20) / F.lit(20.0)).cast("string"), d % 4, d % 3, d % 5, d % 2, d % 6)
    runs = evaluation.parse_grid_log(table(spark, sf_dir, "documents").select(line.alias("value")))
    got = evaluation.grid_marginals(runs, "parent_chunk_size", "parent_chunk_overlap", "child_chunk_size", "child_chunk_overlap", "number_of_docs")
    return got.select("parameter", "value", "runs", _rounded("mean_score", "mean_score"))


# Sketches


@query("""SELECT kind, count(*) AS rows, count(DISTINCT client_id) AS clients, true AS distinct_near, true AS median_near, true AS whole_is_parts FROM clicks GROUP BY kind""")
def click_sketches(spark, sf_dir):
    """Distinct clients and the median value by kind from states kept for each day and kind, against exact figures: within 3 % of either, and the same from days as from the whole."""
    clicks = table(spark, sf_dir, "clicks").withColumn("day", F.to_date("ts"))
    daily = sketches.sketch(clicks, ["day", "kind"], F.col("client_id"), F.col("value"))
    merged = sketches.estimates(sketches.merge(daily, ["kind"]), [0.5])
    whole = sketches.estimates(sketches.sketch(clicks, ["kind"], F.col("client_id"), F.col("value")), [0.5]).select(F.col("kind").alias("k"), F.col("distinct").alias("at_once"))
    exact = clicks.groupBy("kind").agg(F.count_distinct("client_id").alias("clients"), F.count("value").alias("n")).withColumnRenamed("kind", "e")
    joined = merged.join(whole, F.col("kind").eqNullSafe(F.col("k"))).join(exact, F.col("kind").eqNullSafe(F.col("e")))
    # the rank of the estimated median among all values of its kind
    ranks = clicks.select(F.col("kind").alias("r"), "value").join(joined.select("e", F.get("quantiles", F.lit(0)).alias("median")), F.col("r").eqNullSafe(F.col("e")))
    below = ranks.groupBy("r").agg(F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("up_to"))
    got = joined.join(below, F.col("kind").eqNullSafe(F.col("r")))
    return got.select(
        "kind", "rows", "clients", (F.abs(F.col("distinct") - F.col("clients")) <= 0.03 * F.col("clients")).alias("distinct_near"),
        ((F.col("below") <= 0.53 * F.col("n")) & (F.col("up_to") >= 0.47 * F.col("n"))).alias("median_near"), (F.abs(F.col("distinct") - F.col("at_once")) <= 0.01 * F.col("at_once")).alias("whole_is_parts"),
    )


# Multisets of words

_SAID = r"""said AS (SELECT conv_id AS group_id, role, unnest([x FOR x IN string_split_regex(trim(text), '\s+') IF x <> '']) AS w FROM conversations WHERE text IS NOT NULL)"""


def _turns(spark, sf_dir, role: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & (F.col("role") == role))
    return consistency.tokenize(rows.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("resp_id"), "text"))


@query(f"WITH {_SAID} SELECT group_id, w AS word, count(*) AS times FROM (SELECT group_id, w FROM said WHERE role = 'assistant' EXCEPT ALL SELECT group_id, w FROM said WHERE role = 'user') GROUP BY ALL")
def words_of_answers_alone(spark, sf_dir):
    """How much more often a conversation's answers say a word than its questions do."""
    left = consistency.vocabulary_left(_turns(spark, sf_dir, "assistant"), _turns(spark, sf_dir, "user"))
    return left.groupBy("group_id", F.col("ngram")[0].alias("word")).agg(F.count("*").alias("times"))


@query(f"WITH {_SAID} SELECT group_id, w AS word, count(*) AS times FROM (SELECT group_id, w FROM said WHERE role = 'assistant' INTERSECT ALL SELECT group_id, w FROM said WHERE role = 'user') GROUP BY ALL")
def words_of_both(spark, sf_dir):
    """Words that a conversation's questions and answers share, as often as both say them."""
    both = consistency.vocabulary_shared(_turns(spark, sf_dir, "assistant"), _turns(spark, sf_dir, "user"))
    return both.groupBy("group_id", F.col("ngram")[0].alias("word")).agg(F.count("*").alias("times"))


# Table functions


@query("""SELECT conv_id, CAST(i AS INT) AS position, 'about ' || trim(text[1:12]) AS question FROM conversations, range(2) t(i) WHERE text IS NOT NULL AND trim(text[1:12]) NOT LIKE '%  %' AND NOT regexp_matches(text[1:12], '[\\s\\x{00a0}][\\s\\x{00a0}]|[^ \\S]')""")
def questions_in_sql(spark, sf_dir):
    """Questions of numbered lines, by a table function that SQL calls for each row of a table."""
    table_functions.register(spark)
    start = F.substring("text", 1, 12)
    plain = F.col("text").isNotNull() & ~start.rlike(r"(?U)\s\s|[^ \S]")
    said = F.concat(F.lit("Here:\nQ1: about "), start, F.lit("\nnone\n2. 3: about "), start)
    table(spark, sf_dir, "conversations").where(plain).select("conv_id", said.alias("said")).createOrReplaceTempView("quire_said")
    return spark.sql("select conv_id, q.position, q.question from quire_said, lateral parse_questions(said) q")


@query(f"WITH {X.GRADES}, c AS (SELECT case_id, coalesce(avg(score), 0.0) AS ratio FROM parsed GROUP BY case_id) SELECT case_id, CASE WHEN ratio > 0.5 THEN 1 ELSE 0 END AS score, round(ratio, 6) AS ratio_correct FROM c")
def consensus_in_sql(spark, sf_dir):
    """The vote over each case's grades, by a table function over a partitioned table."""
    table_functions.register(spark)
    X.grades(spark, sf_dir).select("case_id", "sample", "text").createOrReplaceTempView("quire_grades")
    got = spark.sql("select * from consensus_grade(table(select case_id, sample, text from quire_grades) partition by case_id order by sample)")
    return got.select("case_id", "score", _rounded("ratio_correct", "ratio_correct"))


# Depths of runs


@query("""WITH RECURSIVE runs AS (SELECT event_id AS run_id, CASE WHEN event_id % 6 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS parent_id FROM events),
walk AS (SELECT run_id, run_id AS root, parent_id AS top, 0 AS depth FROM runs UNION ALL SELECT w.run_id, r.run_id, r.parent_id, w.depth + 1 FROM walk w JOIN runs r ON w.top = r.run_id)
SELECT run_id, CAST(max(depth) AS BIGINT) AS depth, arg_max(root, depth) AS root FROM walk GROUP BY run_id""")
def trace_depths(spark, sf_dir):
    """How deep each run lies, and the run that all began with."""
    before = F.expr("lag(event_id) over (partition by user_id order by ts, event_id)")
    return trace.depths(table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 6 != 0, before).alias("parent_id")))
