"""Joins on time, clusters by group, sketches, table functions, typed metadata and streams with state."""

import json
import math
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import table_functions
from quire.functions import text as T
from quire.operators import clusters, consistency, etl, evaluation, joins, retrieval, sketches
from quire.streaming import state, trace

DAY = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + timedelta(minutes=minutes)


# As-of join


def brute_as_of(left, right, most=None):
    out = []
    for name, key, t in left:
        fits = [(r[1], r[2]) for r in right if key is not None and t is not None and r[0] == key and r[1] is not None and r[1] <= t]
        best = max(fits, key=lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0), default=(None, None))
        out.append((name, best[1] if best[0] is not None and (most is None or t - best[0] <= most) else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_join(spark, seed):
    """A hot key over many ranges, equal times, keys without right rows, nulls, repeated rows."""
    rnd = random.Random(seed)
    key = lambda: rnd.choice([1] * 6 + [2, 3, 4, None])
    left = [(i, key(), at(rnd.choice([None, *range(60)]))) for i in range(400)] + [(7, 1, at(5))] * 3 + [(500, 9, at(30))]
    right = [(key(), at(rnd.choice([None, *range(60)])), rnd.choice([None, *range(50)])) for _ in range(60)] + [(5, at(1), 1)]
    a = spark.createDataFrame(left, "name int, key int, t timestamp_ntz").repartition(5)
    b = spark.createDataFrame(right, "key int, s timestamp_ntz, value int").repartition(4)
    got = joins.as_of(a, b, "key", "t", "s", ["value"])
    assert got.columns == ["name", "key", "t", "value"]
    assert sorted(((r.name, r.value) for r in got.collect()), key=repr) == brute_as_of(left, right)
    near = joins.as_of(a, b, "key", "t", "s", ["value"], most="7 minutes")
    assert sorted(((r.name, r.value) for r in near.collect()), key=repr) == brute_as_of(left, right, timedelta(minutes=7))


def test_as_of_join_of_nothing(spark):
    a = spark.createDataFrame([(1, 1, at(1))], "name int, key int, t timestamp_ntz")
    b = spark.createDataFrame([], "key int, s timestamp_ntz, value string")
    assert [tuple(r) for r in joins.as_of(a, b, "key", "t", "s", ["value"]).collect()] == [(1, 1, at(1), None)]
    assert joins.as_of(a.where("false"), b, "key", "t", "s", ["value"]).collect() == []


def test_a_hot_key_of_an_as_of_join_is_many_tasks(spark):
    """The largest range of one key's rows holds a bounded share of them."""
    a = spark.range(20_000).select(F.col("id").alias("name"), F.lit(1).alias("key"), F.lit(at(5)).alias("t"))
    b = spark.createDataFrame([(1, at(1), 3)], "key int, s timestamp_ntz, value int")
    # small ranges would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = joins.as_of(a, b, "key", "t", "s", ["value"])
        assert got.where("value = 3").count() == 20_000
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and max(sizes) < 15_000


# Interval join


@pytest.mark.parametrize("seconds", [None, 60, 100_000])
def test_intervals_that_meet(spark, seconds):
    rnd = random.Random(3)
    span = lambda: (x := rnd.choice([None, *range(200)]), None if x is None else x + rnd.choice([-3, 0, 0, 5, 40]))
    left = [(i, rnd.choice([1, 1, 1, 2, None]), *map(at, span())) for i in range(80)]
    right = [(i, rnd.choice([1, 1, 1, 2, None]), *map(at, span())) for i in range(80)]
    a, b = (spark.createDataFrame(rows, f"{n} int, key int, {n}b timestamp_ntz, {n}e timestamp_ntz") for n, rows in (("a", left), ("c", right)))
    got = joins.intervals_meet(a, b, "key", ("ab", "ae"), ("cb", "ce"), seconds)
    whole = lambda r: r[1] is not None and r[2] is not None and r[3] is not None and r[2] <= r[3]
    want = [(x[0], y[0]) for x in left for y in right if whole(x) and whole(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted((r.a, r.c) for r in got.collect()) == sorted(want) and want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


# Clusters within groups


def test_clusters_are_those_of_each_group(spark):
    """Groups far from each other do not share clusters; a null vector, equal vectors and a lone one are borne."""
    rnd = random.Random(5)
    rows = []
    for g in range(4):
        for i in range(30):
            center = 100 * g + (5 if i % 3 == 0 else -5)
            rows.append((g, i, [center + rnd.random(), rnd.random()]))
    rows += [(8, i, [1.0, 2.0]) for i in range(5)] + [(9, 0, [3.0, 4.0]), (9, 1, None)]
    df = spark.createDataFrame(rows, "group_id int, resp_id int, vector array<double>").repartition(3)
    found = defaultdict(list)
    for r in clusters.answer_clusters(df).collect():
        found[r.group_id].append((r.cluster, r.size, r.centroid))
    for g in range(4):
        (_, small, c0), (_, large, c1) = sorted(found[g])
        members = [v for h, i, v in rows if h == g and i % 3 == 0]
        assert (small, large) == (10, 20) and np.allclose(c0, np.mean(members, 0)) and abs(c1[0] - (100 * g - 4.5)) < 0.5
    assert [x[:2] for x in found[8]] == [(0, 5)] and [x[:2] for x in found[9]] == [(0, 1)]
    best = {r.group_id: r.resp_id for r in clusters.largest_cluster_rank(df).where("rank = 1").collect()}
    assert all(best[g] % 3 for g in range(1, 4))


def test_three_clusters(spark):
    rows = [(1, i, [float(10 * (i % 3)) + i / 1000, 0.0]) for i in range(31)]
    got = sorted((r.size, round(r.centroid[0])) for r in clusters.answer_clusters(spark.createDataFrame(rows, "group_id int, resp_id int, vector array<double>"), 3).collect())
    assert got == [(10, 10), (10, 20), (11, 0)]


# Embedding scores


@pytest.mark.parametrize("weighted", [False, True])
def test_the_linear_form_is_the_matrix(spark, weighted):
    rnd = random.Random(6)
    rows = [(g, i, [rnd.gauss(0, 1) for _ in range(8)], [-rnd.random() for _ in range(1 + i % 3)]) for g in range(3) for i in range(7)] + [(9, 0, [1.0] * 8, [0.0])]
    df = spark.createDataFrame(rows, "group_id int, resp_id int, vector array<double>, logprobs array<double>")
    unit = df.withColumn("vector", F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y))))
    matrix = consistency.embedding_matrix(unit, weighted).where("i <> j").groupBy("group_id", "i").agg(F.avg("score").alias("s"))
    want = {(r.group_id, r.i): r.s for r in matrix.collect()}
    got = {(r.group_id, r.resp_id): r.score for r in consistency.embedding_scores(df, weighted).collect()}
    assert math.isnan(got.pop((9, 0))) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_matrices_are_bounded(spark):
    df = spark.createDataFrame([(1, i, [1.0], [0.0], ["a"]) for i in range(4)], "group_id int, resp_id int, vector array<double>, logprobs array<double>, tokens array<string>")
    assert consistency.embedding_matrix(df, most=4).count() == 16
    for make in (consistency.embedding_matrix, consistency.similarity_matrix):
        with pytest.raises(Exception, match="at most 3"):
            make(df, most=3).collect()


def test_labelled_answers(spark):
    said = [{"text": t} for t in "abcd"]
    cases = spark.createDataFrame([(1, said, [2, 0], [3, 9]), (2, said, None, [1]), (3, said, [], [])], "group_id int, responses array<struct<text:string>>, good array<int>, bad array<int>")
    assert sorted(map(tuple, evaluation.labelled_answers(cases).collect())) == [(1, 0, True, "c"), (1, 1, True, "a"), (1, 2, False, "d"), (2, 0, False, "b")]


# Nearest neighbours


@pytest.mark.parametrize(("block", "rows", "pivots"), [(4096, 1 << 18, 64), (3, 50, 5)])
def test_nearest_is_exact(spark, monkeypatch, block, rows, pivots):
    """Clustered vectors, so that groups are left out; equal distances, missing numbers, other sizes, nulls."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "RANGE_ROWS", rows)
    monkeypatch.setattr(retrieval, "PIVOTS", pivots)
    rnd = random.Random(7)
    centers = [[rnd.gauss(0, 20) for _ in range(6)] for _ in range(12)]
    corpus = [(i, [c + rnd.gauss(0, 0.1) for c in centers[i % 12]]) for i in range(400)] + [(1000 + i, [float(i // 3)] * 6) for i in range(9)]
    corpus += [(2000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2001, None), (None, [0.0] * 6), (2002, [1.0, 2.0])]
    queries = [(i, v) for i, v in corpus[:40]] + [(5000, [0.0] * 6), (5001, None), (5002, [None] * 6)]
    schema = "id long, vector array<double>"
    got = defaultdict(list)
    for r in retrieval.nearest(spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema).repartition(4), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.distance))
    whole = lambda v: v is not None and len(v) == 6 and None not in v
    for q, v in queries:
        if v is None:
            assert q not in got
            continue
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 6) if whole(v) and whole(w) else math.inf, i) for i, w in corpus if i is not None and w is not None)[:7]
        assert [i for i, _ in got[q]] == [i for _, i in d], q
        assert all(x == y or abs(x - y) < 2e-6 for (_, x), (y, _) in zip(got[q], d, strict=True))


def test_far_groups_are_left_out(spark):
    """Queries in one of many far clusters meet few rows of the others."""
    corpus = spark.range(4000).select("id", F.array((F.col("id") % 40 * 100).cast("double"), (F.rand(3) - 0.5)).alias("vector"))
    queries = corpus.where("id % 400 = 0")
    got = retrieval.nearest(queries, corpus, 5)
    assert got.where(F.pmod("query_id", F.lit(40)) != F.pmod("id", F.lit(40))).count() == 0 and got.count() == 50


def test_few_rows_and_none(spark):
    schema = "id long, vector array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0])], schema)
    assert [(r.query_id, r.id, r.rank) for r in retrieval.nearest(one, one, 3).collect()] == [(1, 1, 1)]
    none = spark.createDataFrame([], schema)
    assert retrieval.nearest(one, none, 3).collect() == [] and retrieval.nearest(none, one, 3).collect() == []


def test_queries_go_where_neighbours_can_be(spark, monkeypatch):
    """Wide groups, none of which its far edge leaves out: a sample and the planes between pivots do."""
    import numpy as np

    rng = np.random.default_rng(2)
    centers = 2 * rng.normal(size=(20, 6))
    rows = [(i, (centers[i % 20] + rng.normal(size=6)).tolist()) for i in range(4000)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    written, keep = {}, retrieval.durable
    monkeypatch.setattr(retrieval, "durable", lambda df, name: written.setdefault(name, keep(df, name)))
    queries = corpus.where("id < 300")
    got = defaultdict(list)
    for r in retrieval.nearest(queries, corpus, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    every = np.array([v for _, v in rows])
    assert got == {q: np.argsort(((every - every[q]) ** 2).sum(1), kind="stable")[:5].tolist() for q in range(300)}
    assert written["nearest-queries"].count() < 300 * 64 / 3


@pytest.mark.parametrize(("scale", "tile", "size"), [(1.0, 16, 400), (1e-4, 16, 400), (1e8, 16, 400), (1e12, 16, 400), (1.0, 512, 3000)])
def test_tiles_leave_out_no_neighbour(monkeypatch, scale, tile, size):
    """Equal rows, equal distances, missing and huge numbers, queries with bounds; rows come in several lots."""
    import numpy as np

    monkeypatch.setattr(retrieval, "TILE_ROWS", tile)
    rng, k = np.random.default_rng(3), 7
    rows = scale * (rng.normal(size=(size, 20)) + 6 * rng.normal(size=(9, 20))[rng.integers(0, 9, size)])
    rows[size // 2 : size // 2 + 60], rows[7], rows[8], rows[9, 3] = rows[0], np.nan, 1e150, np.nan
    asked = np.concatenate([rows[:40] + scale * 0.1 * rng.normal(size=(40, 20)), rows[:10]])
    exact = np.nan_to_num(np.round(((rows[None] - asked[:, None]) ** 2).sum(2), 6), nan=np.inf)
    want = [sorted(zip(d, range(size), strict=True))[:k] for d in exact]
    for bound in (np.full(len(asked), np.inf), np.array([w[-1][0] for w in want]) * (1 + 1e-9) + 1e-5):
        found = retrieval._Best(asked, k, bound)
        for i in range(0, size, size // 3 + 1):
            part = slice(i, i + size // 3 + 1)
            retrieval._Tiles(rows[part], np.arange(size)[part]).meet(found)
        for w, dist, name in zip(want, found.dist, found.name, strict=True):
            if scale <= 1:
                assert list(name) == [i for _, i in w]
            assert dist == pytest.approx([d for d, _ in w], rel=1e-6, abs=1e-6)


# Traces


def test_long_chains_and_cycles(spark):
    """A chain beyond 2^16 runs is walked to its root; runs in a circle are an error."""
    n = 100_000
    runs = spark.range(n).select(F.col("id").alias("run_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert trace.depths(runs).where("depth <> run_id or root <> 0").count() == 0
    short = {r.run_id: r.parent_ids for r in trace.parent_ids(runs.where("run_id < 300")).collect()}
    assert all(short[i] == list(range(i)) for i in range(300))
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None)], "run_id long, parent_id long")
    for walk in (trace.parent_ids, trace.depths):
        with pytest.raises(ValueError, match="ancestors"):
            walk(circle)
    assert [tuple(r) for r in trace.depths(spark.createDataFrame([(4, 99)], "run_id long, parent_id long")).collect()] == [(4, 0, 4)]


# Typed metadata


def test_typed_metadata(spark):
    rows = [(1, '{"page": 3, "score": 0.5, "ok": true, "who": "x", "none": null, "list": [1, 2]}'), (2, "no json"), (3, None), (4, "7"), (5, "{}")]
    df = etl.typed_metadata(spark.createDataFrame(rows, "doc_id int, metadata string"))
    assert dict(df.dtypes)["metadata"] == "variant"
    kinds = {r.doc_id: {x.key: (x.kind, x.value) for x in r.m or []} for r in df.select("doc_id", etl.metadata_primitives("metadata", ["page", "score", "ok", "who", "none", "list", "gone"]).alias("m")).collect()}
    assert kinds[1] == {"page": ("bigint", "3"), "score": ("decimal(1,1)", "0.5"), "ok": ("boolean", "true"), "who": ("string", "x"), "none": ("void", "None"), "list": ("array<bigint>", "[1,2]")}
    assert kinds[3] == kinds[4] == kinds[5] == {}
    pages = {r.doc_id: r.p for r in df.select("doc_id", etl.metadata_value("metadata", "$.page", "int").alias("p")).collect()}
    assert pages == {1: 3, 2: None, 3: None, 4: None, 5: None}


def test_token_chunks_carry_their_own_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "doc_id int, text string")
    got = etl.token_chunks(docs, T.whitespace_tokens("text"), 3, 1)
    assert [(r.doc_id, r.chunk_index, r.chunk) for r in got.orderBy("doc_id", "chunk_index").collect()] == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e f g")]
    assert "Generate posexplode(transform" in got._jdf.queryExecution().executedPlan().toString().replace("explode(", "explode(")


# Grouping sets, sketches, multisets


def test_grid_marginals(spark):
    runs = spark.createDataFrame([(1, None, 0.5), (1, 2, 1.0), (2, 2, 0.0)], "a int, b int, score double")
    got = {(r.parameter, r.value): (r.runs, r.mean_score) for r in evaluation.grid_marginals(runs, "a", "b").collect()}
    assert got == {("a", "1"): (2, 0.75), ("a", "2"): (1, 0.0), ("b", None): (1, 0.5), ("b", "2"): (2, 0.5), ("all", None): (3, 0.5)}
    assert evaluation.grid_marginals(runs, "a", "b")._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1


def test_sketches_of_halves_are_those_of_the_whole(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("who"), (F.col("id") % 1000).cast("double").alias("x"), (F.col("id") % 2).alias("half"))
    for half in (0, 1):
        sketches.sketch(rows.where(F.col("half") == half), ["g"], F.col("who"), F.col("x")).write.mode("append").parquet(f"{tmp_path}/states")
    merged = {r.g: r for r in sketches.estimates(sketches.merge(spark.read.parquet(f"{tmp_path}/states"), ["g"]), [0.25, 0.5, 0.9]).collect()}
    whole = {r.g: r for r in sketches.estimates(sketches.sketch(rows, ["g"], F.col("who"), F.col("x")), [0.25, 0.5, 0.9]).collect()}
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("who").alias("n")).collect()}
    for g in range(3):
        assert merged[g].rows == whole[g].rows == 20_000 and merged[g].distinct == whole[g].distinct
        assert abs(merged[g].distinct / exact[g] - 1) < 0.03
        assert all(abs(q - p * 1000) < 15 for q, p in zip(merged[g].quantiles, (0.25, 0.5, 0.9), strict=True))
    empty = sketches.estimates(sketches.merge(sketches.sketch(rows.where("false"), ["g"], F.col("who"), F.col("x")), ["g"]))
    assert empty.collect() == []


def test_vocabularies_as_multisets(spark):
    say = lambda rows: consistency.tokenize(spark.createDataFrame(rows, "group_id int, resp_id int, text string"))
    ours, theirs = say([(1, 0, "a a b c"), (1, 1, "a"), (2, 0, "x")]), say([(1, 0, "a b b"), (3, 0, "x")])
    count = lambda df: Counter((r.group_id, " ".join(r.ngram)) for r in df.collect())
    assert count(consistency.vocabulary_left(ours, theirs)) == {(1, "a"): 2, (1, "c"): 1, (2, "x"): 1}
    assert count(consistency.vocabulary_shared(ours, theirs)) == {(1, "a"): 1, (1, "b"): 1}
    assert count(consistency.vocabulary_left(ours, theirs, 2))[1, "a a"] == 1


# Table functions


def test_functions_in_sql(spark):
    names = table_functions.register(spark)
    assert {"parse_questions", "recursive_chunks", "consensus_grade", "has_sentence_end", "squared_distance"} == set(names)
    texts = ["Q1: who  is it?\n  2. no\n3. 4: what\n5. \nnone", "", None, "1. only", "Q1:no blank"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, said string")
    df.createOrReplaceTempView("t_said")
    want = {r.i: r.q for r in df.select("i", T.parse_questions("said").alias("q")).collect()}
    got = defaultdict(list)
    for r in spark.sql("select i, q.* from t_said, lateral parse_questions(said) q order by i, position").collect():
        got[r.i].append(r.question)
    assert {i: got.get(i, []) for i in range(5)} == {i: q or [] for i, q in want.items()}
    chunks = spark.sql("select i, c.* from t_said, lateral recursive_chunks(said, 12, 0, 'characters') c order by i, position").collect()
    column = etl.recursive_chunks(df.withColumnRenamed("said", "text").withColumnRenamed("i", "doc_id"), 12, 0).collect()
    assert sorted((r.i, r.position, r.chunk) for r in chunks) == sorted((r.doc_id, r.chunk_index, r.chunk) for r in column)
    assert spark.sql("select has_sentence_end('x?) ') as a, has_sentence_end('x') as b, squared_distance(array(1d, 2d), array(1d, 4d)) as d").first() == (True, False, 4.0)
    with pytest.raises(Exception, match="characters or tokens"):
        spark.sql("select * from recursive_chunks('abc', 1, 0, 'bytes')").collect()


def test_a_vote_over_partitions(spark):
    table_functions.register(spark)
    texts = ["The grade. GRADE: CORRECT", "GRADE: CORRECT", "incorrect", None, "no verdict", "  ok GRADE:  incorrect", "Correct!", "x GRADE: CORRECTLY", ""]
    rows = [(c, s, texts[(c * 5 + s * 2) % len(texts)]) for c in range(6) for s in range(4)]
    df = spark.createDataFrame(rows, "case_id long, sample int, text string")
    df.createOrReplaceTempView("t_grades")
    got = {r.case_id: (r.score, r.value, round(r.ratio_correct, 9)) for r in spark.sql("select * from consensus_grade(table(t_grades) partition by case_id order by sample)").collect()}
    want = evaluation.consensus(df.withColumn("grade", T.grade("text")), "case_id", "sample")
    assert got == {r.case_id: (r.score, r.value, round(r.ratio_correct, 9)) for r in want.collect()}


# Streams with state


def test_runs_of_a_stream(spark, tmp_path):
    """Ends before starts, rows late but within the watermark and beyond it, a run without end, and a restart from the checkpoint."""
    before = spark.conf.get(state.STORE[0], None)
    inp = tmp_path / "in"
    inp.mkdir()

    def put(n, rows):
        (tmp_path / "part").write_text("\n".join(json.dumps({"run_id": r, "event": e, "ts": f"2024-01-01T{t}"}) for r, e, t in rows))
        os.rename(tmp_path / "part", inp / f"{n}.json")

    def go():
        events = spark.readStream.schema("run_id string, event string, ts timestamp").json(str(inp))
        state.tracked_runs(events, "10 minutes", 60, 3600).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(ValueError, match="timers"):
        spark.conf.unset(state.STORE[0])
        go()
    spark.conf.set(*state.STORE)
    try:
        put(1, [("a", "start", "00:00:00"), ("a", "end", "00:00:05"), ("b", "end", "00:01:00"), ("c", "start", "00:00:30"), (None, "start", "00:00:00"), ("e", "error", "00:00:40")])
        go()
        put(2, [("b", "start", "00:00:50"), ("a", "end", "00:00:07"), ("d", "start", "00:20:00")])
        go()
        put(3, [("z", "start", "05:00:00")])
        go()
        put(4, [("a", "end", "00:00:09"), ("y", "start", "05:00:01")])
        go()
        got = {r.run_id: (r.state, r.micros, r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.unset(state.STORE[0]) if before is None else spark.conf.set(state.STORE[0], before)
    assert got == {"a": ("ended", 7_000_000, 3), "b": ("ended", 10_000_000, 2), "c": ("open", None, 1), "d": ("open", None, 1), "e": ("unstarted", None, 1)}


def test_distances_are_worked_out_once_a_vector(spark):
    rows = spark.createDataFrame([(1, i, [float(i), 1.0, 2.0]) for i in range(4)], "group_id int, resp_id int, vector array<double>")
    plan = clusters._places(rows, rows.groupBy("group_id").agg(F.collect_list("vector").alias("centers")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("array_position")


def test_texts_are_split_a_part_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(etl, "PART_BYTES", 10)
    texts = ["aaaa", None, "bbbbb", "c" * 30, "", "dd"]
    parts = [p.to_pylist() for p in etl.parts_of(pa.array(texts))]
    assert parts == [["aaaa", None, "bbbbb"], ["c" * 30], ["", "dd"]]
    assert list(etl.parts_of(pa.array([], pa.string()))) == []
