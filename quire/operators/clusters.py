"""Clusters of each question's answers: one k-means a group, all groups in the same jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.vectors import cosine, once
from quire.plans.storage import discard, durable

#: A centroid that moves less than this in every place has come to rest.
AT_REST = 1e-12


def _distances(vector: Column, centers: Column) -> Column:
    """Squared distances to each center, rounded so that sums in another order do not decide ties."""
    squares = lambda c: F.zip_with(vector, c, lambda x, y: (x - y) * (x - y))
    return F.transform(centers, lambda c: F.round(F.aggregate(squares(c), F.lit(0.0), lambda s, x: s + x), 9))


def _nearest(vector: Column, centers: Column) -> Column:
    return once(_distances(vector, centers), lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def _seeds(rows: DataFrame, k: int) -> DataFrame:
    """(group_id, centers): of each group the vector of least md5 of its index, then k-1 times the one furthest from those chosen; ties by index."""
    first = F.struct(F.md5(F.col("resp_id").cast("string")), "resp_id")
    centers = rows.groupBy("group_id").agg(F.array(F.min_by("vector", first)).alias("centers"))
    for _ in range(k - 1):
        far = F.struct(-F.array_min(_distances(F.col("vector"), F.col("centers"))), "resp_id")
        centers = rows.join(centers, "group_id").groupBy("group_id").agg(F.any_value("centers").alias("chosen"), F.min_by("vector", far).alias("next"))
        centers = centers.select("group_id", F.concat("chosen", F.array("next")).alias("centers"))
    return centers


def _places(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(group_id, cluster, pos, x) of each place of each vector; in two steps, as beside posexplode the distances would be worked out for each place anew."""
    placed = rows.join(centers, "group_id").select("group_id", "vector", _nearest(F.col("vector"), F.col("centers")).alias("cluster"))
    return placed.select("group_id", "cluster", F.posexplode("vector").alias("pos", "x"))


def group_centers(vectors: DataFrame, k: int = 2, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, centers): vectors as doubles, and (group_id, centers) after at most ``rounds`` of Lloyd's steps within each group.

    A round is one job for all groups: rows meet the centers of their group (one row a group, so a hot group's
    rows can be split), and means are partial sums by (group, cluster, place). A cluster that loses all
    rows keeps its center. Centers are written each round, so plans do not grow. Null vectors are dropped.
    """
    rows = vectors.where("vector is not null").select("group_id", "resp_id", F.col("vector").cast("array<double>").alias("vector"))
    centers = durable(_seeds(rows, k), "cluster-centers")
    for _ in range(rounds):
        means = _places(rows, centers).groupBy("group_id", "cluster", "pos").agg(F.avg("x").alias("x"))
        means = means.groupBy("group_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
        means = means.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"))
        moved = centers.join(means, "group_id").select("group_id", F.col("centers").alias("old"), F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("means", i), c)).alias("centers"))
        moving = F.exists(F.zip_with(F.flatten("old"), F.flatten("centers"), lambda a, b: F.abs(a - b) > AT_REST), lambda x: x)
        after = durable(moved.select("group_id", "centers", moving.alias("moving")), "cluster-centers")
        still = after.where("moving").isEmpty()
        discard(centers)
        centers = after
        if still:
            break
    return rows, centers.select("group_id", "centers")


def answer_clusters(vectors: DataFrame, k: int = 2, rounds: int = 10) -> DataFrame:
    """(group_id, cluster, seed, size, centroid): the clusters of each group that have rows, numbered by size ascending, then by seed."""
    rows, centers = group_centers(vectors, k, rounds)
    sizes = rows.join(centers, "group_id").groupBy("group_id", _nearest(F.col("vector"), F.col("centers")).alias("seed")).agg(F.count("*").alias("size"))
    named = sizes.join(centers, "group_id").select("group_id", "seed", "size", F.get("centers", F.col("seed")).alias("centroid"))
    return named.withColumn("cluster", F.row_number().over(W.partitionBy("group_id").orderBy("size", "seed")) - 1)


def largest_cluster_rank(vectors: DataFrame, k: int = 2, rounds: int = 10) -> DataFrame:
    """(group_id, resp_id, score, rank): answers by cosine to the centroid of their group's largest cluster (of equals the first seed), best first."""
    found = answer_clusters(vectors, k, rounds)
    largest = found.groupBy("group_id").agg(F.max_by("centroid", F.struct("size", -F.col("seed"))).alias("centroid"))
    scored = vectors.where("vector is not null").join(largest, "group_id").select("group_id", "resp_id", F.round(cosine(F.col("vector"), F.col("centroid")), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("score"), F.desc("resp_id"))))
