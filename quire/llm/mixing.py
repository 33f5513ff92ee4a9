"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.storage import durable

WORDS = r"[^\x20\x09-\x0D]+"
#: Buckets of the shuffled order of a source, and bins of virtual time that are summed at once.
BUCKETS, BINS = 4096, 4096
#: A bin of virtual time with more rows than this is divided again.
BIN_ROWS = 50_000


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size and the source's rank by code point from 0 (null last); no task sees all sources."""
    parts = durable(
        sizes.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    starts = parts.groupBy("part").count().withColumn("start", F.sum("count").over(W.orderBy("part")) - F.col("count"))
    order = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(F.broadcast(starts.drop("count")), "part").select(
        "source", "source_size", (F.col("start") + F.row_number().over(order) - 1).alias("rank")
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> tuple[DataFrame, float]:
    """Each source's target: its weight's part of ``share`` of all words, at most ``epochs`` times its size.

    What a cap takes away is shared again by weight until no target is above its cap. A round is one
    aggregation over the sources. Returns (source, source_size, target) and the budget.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = durable(ranked_sources(sizes).withColumn("weight", weight), "mix-ranked")
    cap, level = F.col("source_size") * epochs, -1.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    while True:
        free = cap >= F.lit(level) * F.col("weight")
        capped, weight_sum = sources.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        new = (budget - (capped or 0)) / weight_sum if weight_sum else level
        if new == level:
            break
        level = new
    return sources.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target")), budget


def shuffled_by() -> Column:
    """The md5 of a row's id; of its text where it has no id, so that such rows do not stand together."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))))


def mix_sources(
    docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, size: Column | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Documents of a source queue in an order shuffled by the md5 of their id, or else text, ``epochs`` times over.
    A document's virtual finish time is the words of its source up to and with it, divided by the
    source's target; all documents are taken in the order of that time until the budget is used.
    Documents are taken whole. The order is found by sums over ranges of it, so that no task holds a source.

    Returns doc_id, source, size, source_size, target, taken. Null text has size 0; a null source is one of
    its own, last; rows of equal doc_id, source and size (without id: and text) rank alike and are taken together; a source
    without words, and an empty table, take nothing. Columns named in ``carry`` are returned too, others are dropped.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long") if size is None else size
    base = durable(docs.select("doc_id", "source", *carry, size.alias("size"), shuffled_by().alias("h")), "mix-base")
    goals, budget = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)

    base = base.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % BUCKETS)
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words"))
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    starts = before.join(goals, same_source(before, goals)).select(
        before["source"].alias("s"), before["bucket"].alias("b"), "before", "source_size", "target"
    )
    queue = base.join(starts, base["source"].eqNullSafe(starts["s"]) & (base["bucket"] == starts["b"]))
    within = W.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").cast("string").asc_nulls_last(), "size")
    cum = F.col("before") + F.sum("size").over(within)
    done = durable(
        queue.select("doc_id", "source", *carry, "size", "source_size", "target", "h", cum.alias("cum")), "mix-queue"
    )

    turns = [((F.col("cum") + e * F.col("source_size")) / F.col("target")) for e in range(epochs)]
    times = done.where("size > 0 and target > 0").select(
        "size", F.posexplode(F.array(*turns)).alias("epoch", "v"), "source", "h", "doc_id"
    )
    last = _last_taken(times, int(budget), float(epochs))
    if last is None:
        taken = F.lit(0)
    else:
        taken = sum((F.when(_key(v, F.lit(e)) <= last, 1).otherwise(0) for e, v in enumerate(turns)), F.lit(0))
    return done.select(
        "doc_id", "source", *carry, "size", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * taken).otherwise(0).cast("long").alias("taken"),
    )


def _key(v: Column, epoch: Column) -> Column:
    """The total order of turns; rows that are equal in it are taken together."""
    return F.struct(
        v.alias("v"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), F.col("h").alias("h"),
        epoch.cast("int").alias("epoch"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size").cast("long").alias("size"),
    )


def _last_taken(times: DataFrame, budget: int, most: float) -> Column | None:
    """The key of the last turn within the budget, as a literal; None if there is none.

    Ranges of virtual time are summed, and the one where the budget ends is divided again until few
    rows are left in it.
    """
    low, high, used = 0.0, max(most, 2.0) + 1e-9, 0
    inside = times
    while True:
        width = (high - low) / BINS
        bins = inside.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = bins.withColumn("upto", F.sum("words").over(W.orderBy("bin")))
        cut = upto.where(F.col("upto") > budget - used).orderBy("bin").first()
        if cut is None:
            return _literal(inside.agg(F.max(_key(F.col("v"), F.col("epoch")))).first()[0]) if low == 0 else None
        used += cut["upto"] - cut["words"]
        inside = times.where(F.col("v").between(cut["first"], cut["last"]))
        if cut["n"] <= BIN_ROWS or cut["first"] == cut["last"]:
            break
        low, high = cut["first"], cut["last"]
    key = _key(F.col("v"), F.col("epoch"))
    fits = inside.select(key.alias("k"), F.sum("size").over(W.orderBy(key)).alias("upto")).where(F.col("upto") <= budget - used)
    last = fits.agg(F.max("k")).first()[0]
    if last is None:  # the budget ends with an earlier bin
        last = times.where(F.col("v") < cut["first"]).agg(F.max(key)).first()[0]
    return _literal(last)


def _literal(key) -> Column | None:
    return key and F.struct(*[F.lit(x).cast(t).alias(n) for (n, x), t in zip(key.asDict().items(), ("double", "boolean", "string", "string", "int", "boolean", "string", "long"), strict=True)])


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mix_sources``: null and empty texts have size 0 and are not taken, null sources are one source, equal rows are taken alike."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w,
         1.5::DOUBLE * (SELECT sum(source_size) FROM sizes)::DOUBLE AS budget
  FROM sizes),
levels AS (
  SELECT *, (budget - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(w) OVER (ORDER BY source_size / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
level AS (SELECT level FROM levels WHERE level * w <= 2 * source_size ORDER BY source_size / w::DOUBLE, source LIMIT 1),
goals AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, level.level * w) AS target, budget FROM levels, level),
queue AS (
  SELECT b.*, g.source_size, g.target, g.budget,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, CAST(b.doc_id AS VARCHAR) NULLS LAST, b.size) AS cum
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),
times AS (
  SELECT *, e AS epoch, (cum + e * source_size)::DOUBLE / target AS v
  FROM queue, (VALUES (0), (1)) t(e) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY v, source IS NULL, coalesce(source, ''), h, epoch, CAST(doc_id AS VARCHAR) NULLS LAST, size) AS upto FROM times),
mix AS (SELECT doc_id, source, h, size, count(DISTINCT epoch) AS turns FROM ordered WHERE upto <= floor(budget) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(m.turns, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN mix m ON q.doc_id IS NOT DISTINCT FROM m.doc_id AND q.source IS NOT DISTINCT FROM m.source AND q.size = m.size AND q.h = m.h
"""
