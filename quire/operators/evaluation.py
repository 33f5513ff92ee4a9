"""Evaluation of answers: votes over grades, accuracy, average precision, means over parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Fixed value: the reasoning where no grade could be read.
NO_CONSENSUS = "No consensus"


def consensus(grades: DataFrame, case: str, order: str, grade: str = "grade") -> DataFrame:
    """(case, score, value, reasoning, ratio_correct): the majority of the grades that could be read.

    Over half correct: the first correct grade; else the first incorrect one. None read: score 0 and
    the reasoning ``No consensus``.
    """
    g = F.col(grade)
    right = g["value"] == "CORRECT"
    ratio = F.coalesce(F.avg(F.when(g.isNotNull(), right.cast("double"))), F.lit(0.0))
    first = lambda ok: F.min(F.when(g.isNotNull() & ok, F.struct(order, g.alias("g"))))
    got = grades.groupBy(case).agg(ratio.alias("ratio_correct"), first(right)["g"].alias("right"), first(~right)["g"].alias("wrong"))
    best = F.when(F.col("ratio_correct") > 0.5, F.col("right")).otherwise(F.col("wrong"))
    return got.select(
        case, F.coalesce(best["score"], F.lit(0)).alias("score"), F.coalesce(best["value"], F.lit("INCORRECT")).alias("value"),
        F.coalesce(best["reasoning"], F.lit(NO_CONSENSUS)).alias("reasoning"), "ratio_correct",
    )


def accuracy(scores: DataFrame, score: str = "score") -> DataFrame:
    """The mean score; empty input divides by nothing and is null."""
    return scores.agg(F.avg(score).alias("accuracy"), F.count("*").alias("n"))


def examples_of(given: Column, wrong: Column, correct: Column) -> Column:
    """Given examples, then wrong ones with score 0, then correct ones with score 1, as (query, prediction, score)."""
    overlay = lambda xs, s, v: F.transform(xs, lambda x: x.withField("score", F.lit(s)).withField("value", F.lit(v)))
    return F.concat(given, overlay(wrong, 0, "INCORRECT"), overlay(correct, 1, "CORRECT"))


def labelled_answers(cases: DataFrame, case: str = "group_id") -> DataFrame:
    """Rows (case, resp_id, hit, and the fields of a response) of cases with arrays ``responses``, ``good`` and ``bad`` (indices from 0).

    Good answers come first, then bad ones, each in the order of their list, and are numbered anew; answers in neither
    list, and indices without an answer, are left out.
    """
    pick = lambda places, hit: F.transform(places, lambda i: F.struct(F.get("responses", i).alias("r"), F.lit(hit).alias("hit")))
    named = F.filter(F.concat(F.coalesce(pick("good", True), F.array()), F.coalesce(pick("bad", False), F.array())), lambda x: x["r"].isNotNull())
    return cases.select(case, F.posexplode(named).alias("resp_id", "x")).select(case, "resp_id", "x.hit", "x.r.*")


def average_precision(ranks: DataFrame, *case: str) -> DataFrame:
    """(case, ap) of rows (case, rank, hit): the sum of the precisions at hits, divided by all hits; 0 without any."""
    hits = F.sum(F.col("hit").cast("int")).over(W.partitionBy(*case).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    at = ranks.withColumn("p", F.when(F.col("hit"), hits / F.row_number().over(W.partitionBy(*case).orderBy("rank"))))
    found = F.sum(F.col("hit").cast("int"))
    return at.groupBy(*case).agg(F.when(found > 0, F.sum("p") / F.nullif(found, F.lit(0))).otherwise(0.0).alias("ap"))


def mean_average_precision(ranks: DataFrame) -> DataFrame:
    """(method, map, top_correct) of rows (method, case, rank, hit), rounded to 2 places, best first."""
    ap = average_precision(ranks, "method", "case").groupBy("method").agg(F.round(F.avg("ap"), 2).alias("map"))
    top = ranks.where("rank = 1").groupBy("method").agg(F.round(F.avg(F.col("hit").cast("double")), 2).alias("top_correct"))
    return ap.join(top, "method").orderBy(F.desc("map"), "method")


GRID = "parent_chunk_size int, parent_chunk_overlap int, child_chunk_size int, child_chunk_overlap int, number_of_docs int"


def parse_grid_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``[score, {parameters}]`` as score and the parameters; lines of another form are dropped."""
    parts = F.from_json(column, "array<string>")
    got = lines.select(parts[0].cast("double").alias("score"), F.from_json(parts[1], GRID).alias("p"))
    return got.where("score is not null and p is not null").select("score", "p.*")


def grid_summary(runs: DataFrame) -> DataFrame:
    """Runs, mean, least and greatest score of each setting."""
    return runs.groupBy("parent_chunk_size", "parent_chunk_overlap", "child_chunk_size", "child_chunk_overlap", "number_of_docs").agg(
        F.count("*").alias("runs"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def grid_marginals(runs: DataFrame, *parameters: str) -> DataFrame:
    """(parameter, value, runs, mean_score): the mean score at each value of each parameter, and over all runs (parameter ``all``), in one pass over the runs.

    A row is expanded into its grouping sets before one partial aggregation, whatever the number of parameters.
    """
    totals = runs.groupingSets([[F.col(p)] for p in parameters] + [[]], *parameters).agg(F.grouping_id().alias("set"), F.count("*").alias("runs"), F.avg("score").alias("mean_score"))
    # a bit of the set's number is 0 for the parameter that it keeps
    kept = [(totals["set"].bitwiseAND(F.lit(1 << (len(parameters) - 1 - i))) == 0, p) for i, p in enumerate(parameters)]
    name, value = F.lit("all"), F.lit(None).cast("string")
    for is_kept, p in kept:
        name, value = F.when(is_kept, F.lit(p)).otherwise(name), F.when(is_kept, F.col(p).cast("string")).otherwise(value)
    return totals.select(name.alias("parameter"), value.alias("value"), "runs", "mean_score")
