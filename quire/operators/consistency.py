"""Self-consistency: how well each sampled answer agrees with the others of its group.

Responses are rows (group_id, resp_id, text, tokens, logprobs). N-gram vectors are long tables, and
scores that are defined over an n x n matrix are computed from column sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import whitespace_tokens
from quire.functions.vectors import centroids, cosine, dot, normalized
from quire.plans.storage import durable

KEYS = ("group_id", "resp_id")


def tokenize(responses: DataFrame) -> DataFrame:
    """Adds tokens (words) and logprobs of 0."""
    return responses.withColumn("tokens", whitespace_tokens("text")).withColumn("logprobs", F.transform("tokens", lambda _: F.lit(0.0)))


def mean_probability(logprobs: Column) -> Column:
    """exp of the mean log probability; null for no tokens."""
    return F.exp(F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(logprobs), F.lit(0)))


def ngrams(responses: DataFrame, n: int, weighted: bool) -> DataFrame:
    """(group_id, resp_id, k, ngram, logprob) of every occurrence of 1- to n-grams."""
    lp = F.col("logprobs") if weighted else F.transform("tokens", lambda _: F.lit(0.0))
    size = F.size("tokens")

    def of_length(k: int) -> Column:
        def at(i: Column) -> Column:
            part = F.aggregate(F.slice("_lp", i, k), F.lit(0.0), lambda s, x: s + x)
            return F.struct(F.lit(k).alias("k"), F.slice("tokens", i, k).alias("ngram"), part.alias("logprob"))

        return F.when(size >= k, F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), at)).otherwise(F.array().cast("array<struct<k:int,ngram:array<string>,logprob:double>>"))

    every = F.concat(*[of_length(k) for k in range(1, n + 1)])
    return responses.withColumn("_lp", lp).select(*KEYS, F.explode(every).alias("g")).select(*KEYS, "g.*")


def _own_ngrams(responses: DataFrame, n: int, weighted: bool, *facts: str) -> DataFrame:
    """(group_id, resp_id, facts, k, ngram, p): each answer's 1- to n-grams once, with their mean probability; 1 if not weighted.

    Here an n-gram is text, each token with its length before it, which takes a third of an array's memory. The answers are dealt by
    ``dealt``, all n-grams of one to one task, and so need no exchange to be counted.
    """
    marked = F.transform("tokens", lambda t: F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")))
    missing = F.array_repeat(F.lit(0.0), F.greatest(F.size("tokens") - F.size("logprobs"), F.lit(0)))
    rows = responses.select(*KEYS, *facts, marked.alias("_t"), *([F.concat("logprobs", missing).alias("_lp")] if weighted else []))
    size = F.size("_t")

    def of_length(k: int) -> Column:
        def gram(i: Column) -> Column:
            return F.concat(*[F.get("_t", i + j) for j in range(k)])

        def with_p(i: Column) -> Column:
            return F.struct(F.lit(k).alias("k"), gram(i).alias("ngram"), F.exp(sum((F.get("_lp", i + j) for j in range(k)), F.lit(0.0))).alias("p"))

        places = F.sequence(F.lit(0), F.greatest(size - k, F.lit(0)))
        # distinct texts are found by a hash set, distinct structs by comparing all with all
        every = F.transform(places, with_p) if weighted else F.transform(F.array_distinct(F.transform(places, gram)), lambda g: F.struct(F.lit(k).alias("k"), g.alias("ngram")))
        return F.when(size >= k, every).otherwise(F.slice(every, 1, 0))

    said = rows.select(*KEYS, *facts, F.explode(F.concat(*[of_length(k) for k in range(1, n + 1)])).alias("g")).select(*KEYS, *facts, "g.*")
    return said.groupBy(*KEYS, *facts, "k", "ngram").agg(F.avg("p").alias("p")) if weighted else said.withColumn("p", F.lit(1.0))


#: N-grams that one task handles at once, about, and those of a group from which it is dealt to several.
TASK_NGRAMS, GROUP_NGRAMS = 1 << 19, 1 << 16


def _dealt(responses: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Answers, written once, in as many parts as they have n-grams for, and that number: so a task's memory does not grow with the input.

    ``shards`` is the number of parts that the n-grams of the group are to be dealt to. The groups of more than one, which are
    broadcast, are at most one for ``GROUP_NGRAMS`` n-grams.
    """
    rows = durable(responses.select(*KEYS, "tokens", "logprobs"), "consistency-responses")
    total = rows.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = max(1, -(-total * n // TASK_NGRAMS))
    large = rows.groupBy(F.col("group_id").alias("_group")).agg(F.ceil(F.sum(F.size("tokens")) * n / GROUP_NGRAMS).alias("_shards")).where("_shards > 1")
    sharded = rows.join(F.broadcast(large), F.col("group_id").eqNullSafe(F.col("_group")), "left").withColumn("shards", F.coalesce("_shards", F.lit(1)))
    return sharded.drop("_group", "_shards").repartition(parts, *KEYS), parts


def _by_ngram(grams: DataFrame, parts: int) -> DataFrame:
    """The n-grams dealt by (group_id, shard): a small group to one task, so that its sums are there and few rows go on."""
    return grams.withColumn("shard", F.pmod(F.xxhash64("ngram"), F.col("shards"))).drop("shards").repartition(parts, "group_id", "shard")


def vocabulary_sizes(responses: DataFrame, n: int = 1) -> DataFrame:
    """(group_id, vocabulary): the number of different 1- to n-grams of each group that has one."""
    rows, parts = _dealt(responses.withColumn("logprobs", F.array().cast("array<double>")), n)
    grams = _own_ngrams(rows, n, False, "shards").select("group_id", "shards", "ngram")
    return _by_ngram(grams, parts).distinct().groupBy("group_id").agg(F.count("*").alias("vocabulary"))


def _scores_of(responses: DataFrame, methods) -> DataFrame:
    """(group_id, resp_id, a column for each method) of methods (name, n-grams, weighted, weighted by the answer's own probability)."""
    most = max(n for _, n, *_ in methods)
    rows, parts = _dealt(responses, most)
    keyed = rows.withColumns({"L": F.size("tokens"), "own": mean_probability(F.col("logprobs"))})
    grams = _own_ngrams(keyed, most, any(weighted for _, _, weighted, _ in methods), "L", "own", "shards")

    def weight(n: int, weighted: bool, own: bool) -> Column:
        w = (F.col("p") if weighted else F.lit(1.0)) * (F.col("own") if own else F.lit(1.0))
        w = w * length_factor(F.col("L"), F.col("k")) if n > 1 else w
        return w if n == most else F.when(F.col("k") <= n, w)

    weights = _by_ngram(grams.select(*KEYS, "shards", "k", "ngram", *[weight(*how).alias(name) for name, *how in methods]), parts)
    same = W.partitionBy("group_id", "shard", "ngram")
    first = F.row_number().over(same.orderBy("resp_id")) == 1
    products = weights.select(*KEYS, "k", first.alias("first"), *[(F.col(name) * (F.sum(name).over(same) - F.col(name))).alias(name) for name, *_ in methods])
    lengths = sorted({n for _, n, *_ in methods})
    sums = products.groupBy(*KEYS).agg(*[F.count_if(F.col("first") & (F.col("k") <= n)).alias(f"v{n}") for n in lengths], *[F.sum(name).alias(name) for name, *_ in methods])
    out = rows.select(*KEYS).where("group_id is not null").join(sums, list(KEYS), "left")
    group = W.partitionBy("group_id")
    out = out.select("*", F.count("*").over(group).alias("n"), *[F.coalesce(F.nullif(F.sum(f"v{n}").over(group), F.lit(0)), F.lit(1)).alias(f"s{n}") for n in lengths])
    score = lambda name, n: F.when(F.col("n") == 1, F.lit(float("nan"))).otherwise(F.coalesce(name, F.lit(0.0)) / F.nullif(F.col(f"s{n}") * (F.col("n") - 1), F.lit(0)))
    return out.select(*KEYS, *[score(name, n).alias(name) for name, n, *_ in methods])


def length_factor(length: Column, k: Column) -> Column:
    return length / F.coalesce(F.nullif(length - k - 1, F.lit(0)), F.lit(1))


def ngram_weights(responses: DataFrame, n: int = 1, weighted: bool = False, generation_weighted: bool = False) -> DataFrame:
    """(group_id, resp_id, ngram, w): an n-gram's mean probability, for n > 1 times L/(L-k-1), and the answer's own probability if asked.

    Where L = k+1, which would divide by zero, the divisor is 1, so that short answers take part, too.
    """
    facts = responses.select(*KEYS, F.size("tokens").alias("L"), (mean_probability(F.col("logprobs")) if generation_weighted else F.lit(1.0)).alias("own"))
    mean = ngrams(responses, n, weighted).groupBy(*KEYS, "k", "ngram").agg(F.avg(F.exp("logprob")).alias("p"))
    factor = length_factor(F.col("L"), F.col("k")) if n > 1 else F.lit(1.0)
    return mean.join(facts, list(KEYS)).select(*KEYS, "ngram", (F.col("p") * factor * F.col("own")).alias("w"))


def consistency_scores(responses: DataFrame, n: int = 1, weighted: bool = False, generation_weighted: bool = False) -> DataFrame:
    """(group_id, resp_id, score): the mean of a response's vector products with the others, over the group's vocabulary.

    Each n-gram adds w * (S - w), S being its sum over the group: linear in entries, no pairs. A lone
    response has score NaN, one without tokens 0, one of no group (null) none.
    """
    return _scores_of(responses, (("score", n, weighted, generation_weighted),))


#: The ways of ranking by n-grams that are compared: name, n-grams, weighted, weighted by the answer's own probability.
METHODS = (("unigram", 1, False, False), ("consensus_unigram", 1, True, True), ("bigram", 2, False, False), ("consensus_bigram", 2, True, True))


def embedding_scores(vectors: DataFrame, weighted: bool = False) -> DataFrame:
    """(group_id, resp_id, score): the mean product of a response's unit vector with the others of its group, each scaled by its answer's probability if weighted.

    The off-diagonal mean of ``embedding_matrix`` over unit vectors, without the matrix: v . (S - v) / (n - 1), S being the sum of the
    group, kept place by place. A lone response has score NaN. A weighted answer without tokens has no probability and scores null.
    """
    return embedding_scores_of_both(vectors, weighted).select(*KEYS, F.col("weighted" if weighted else "plain").alias("score"))


def embedding_scores_of_both(vectors: DataFrame, has_logprobs: bool = True) -> DataFrame:
    """(group_id, resp_id, plain, weighted): ``embedding_scores`` of both kinds, over unit vectors that are made once and written."""
    own = mean_probability(F.col("logprobs")) if has_logprobs else F.lit(1.0)
    rows = durable(vectors.select(*KEYS, normalized(F.col("vector")).alias("vector"), own.alias("own")), "unit-vectors")
    places = rows.select("group_id", "own", F.posexplode("vector").alias("pos", "x"))
    sums = places.groupBy("group_id", "pos").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("own")).alias("y"))
    sums = sums.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("s"))
    sums = sums.select("group_id", F.transform("s", lambda p: p["x"]).alias("x"), F.transform("s", lambda p: p["y"]).alias("y"))
    sums = sums.join(rows.groupBy("group_id").agg(F.count("vector").alias("n")), "group_id")
    v, w, single = F.col("vector"), F.col("own"), F.when(F.col("n") == 1, F.lit(float("nan")))
    both = rows.join(sums, "group_id").select(*KEYS, "n", w, dot(v, F.col("x")).alias("x"), dot(v, F.col("y")).alias("y"), dot(v, v).alias("self"))
    others = F.nullif(F.col("n") - 1, F.lit(0))
    return both.select(*KEYS, single.otherwise((F.col("x") - F.col("self")) / others).alias("plain"), single.otherwise((F.col("y") * w - F.col("self") * w * w) / others).alias("weighted"))


def scores_of_all_methods(responses: DataFrame) -> DataFrame:
    """(method, group_id, resp_id, score) of every way of ranking: the answer's own probability, n-grams (``METHODS``), and embeddings (a column ``vector``), plain and weighted.

    ``responses`` are read several times, so they should be a table and not a plan.
    """
    named = lambda rows, name: rows.select(F.lit(name).alias("method"), *KEYS, "score")
    near = durable(embedding_scores_of_both(responses), "embedding-scores")
    return (
        scores_by_method(responses).unionByName(named(responses.withColumn("score", mean_probability(F.col("logprobs"))), "probability"))
        .unionByName(named(near.withColumnRenamed("plain", "score"), "embeddings")).unionByName(named(near.withColumnRenamed("weighted", "score"), "weighted_embeddings"))
    )


def scores_by_method(responses: DataFrame) -> DataFrame:
    """(method, group_id, resp_id, score) of all ``METHODS``: ``consistency_scores`` of each, over n-grams that are built once."""
    scored = F.array(*[F.struct(F.lit(name).alias("method"), F.col(name).alias("score")) for name, *_ in METHODS])
    return _scores_of(responses, METHODS).select(*KEYS, F.explode(scored).alias("m")).select("m.method", *KEYS, "m.score")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """Raises, when it is read, if a group has more than ``most`` answers: a matrix grows with the square of a group."""
    size = rows.select(*KEYS).distinct().groupBy("group_id").agg(F.count("*").alias("_size"))
    too_many = F.raise_error(F.format_string("group %s has %d answers, and a matrix is made of at most %d; use the scores by sums", F.col("group_id").cast("string"), F.col("_size"), F.lit(most)))
    return rows.join(size, "group_id").where(F.when(F.col("_size") > most, too_many.cast("boolean")).otherwise(True)).drop("_size")


def similarity_matrix(responses: DataFrame, n: int = 1, weighted: bool = False, generation_weighted: bool = False, per_pair: bool = False, most: int = 4096) -> DataFrame:
    """(group_id, i, j, score) where responses share an n-gram; all others are 0. Groups of over ``most`` answers raise: ``consistency_scores`` needs no matrix.

    The divisor is the group's vocabulary, or with ``per_pair`` that of the two.
    """
    w = ngram_weights(_bounded(responses, most), n, weighted, generation_weighted)
    left, right = w.select("group_id", "ngram", F.col("resp_id").alias("i"), F.col("w").alias("a")), w.select("group_id", "ngram", F.col("resp_id").alias("j"), F.col("w").alias("b"))
    both = left.join(right, ["group_id", "ngram"]).groupBy("group_id", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("p"), F.count("*").alias("common"))
    if not per_pair:
        size = w.groupBy("group_id").agg(F.count_distinct("ngram").alias("v"))
        return both.join(size, "group_id").select("group_id", "i", "j", (F.col("p") / F.col("v")).alias("score"))
    own = w.groupBy(*KEYS).agg(F.count("*").alias("n"))
    sized = both.join(own.withColumnsRenamed({"resp_id": "i", "n": "ni"}), ["group_id", "i"]).join(own.withColumnsRenamed({"resp_id": "j", "n": "nj"}), ["group_id", "j"])
    return sized.select("group_id", "i", "j", (F.col("p") / (F.col("ni") + F.col("nj") - F.col("common"))).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank: by score descending, then index descending; NaN first."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("score"), F.desc("resp_id"))))


def average_similarity(vectors: DataFrame) -> DataFrame:
    """(group_id, resp_id, score): mean cosine with all of the group, itself included: the product with the mean vector."""
    unit = vectors.withColumn("vector", normalized(F.col("vector")))
    return unit.join(centroids(unit, "group_id", "vector"), "group_id").select(*KEYS, dot(F.col("vector"), F.col("centroid")).alias("score"))


def majority_consensus(vectors: DataFrame) -> DataFrame:
    """(group_id, resp_id, text): the text of greatest average similarity, the lesser text on a tie, at its first index."""
    scores = average_similarity(vectors).withColumn("score", F.round("score", 6))
    named = scores.join(vectors.select(*KEYS, "text"), list(KEYS))
    best = named.groupBy("group_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "text")).alias("k")).select("group_id", F.col("k.text").alias("text"))
    return named.join(best, ["group_id", "text"]).groupBy("group_id", "text").agg(F.min("resp_id").alias("resp_id"))


def similarity_to(vectors: DataFrame, query: Column) -> DataFrame:
    """(group_id, resp_id, score): cosine to a vector."""
    return vectors.select(*KEYS, cosine(F.col("vector"), query).alias("score"))


def cosine_to_centroid(vectors: DataFrame) -> DataFrame:
    joined = vectors.join(centroids(vectors, "group_id", "vector"), "group_id")
    return joined.select(*KEYS, cosine(F.col("vector"), F.col("centroid")).alias("score"))


def embedding_matrix(vectors: DataFrame, weighted: bool = False, most: int = 4096) -> DataFrame:
    """(group_id, i, j, score): products of all vectors of a group, each scaled by its answer's probability if weighted. Groups of over ``most`` raise: ``embedding_scores`` needs no matrix."""
    scale = mean_probability(F.col("logprobs")) if weighted else F.lit(1.0)
    rows = _bounded(vectors, most).select("group_id", "resp_id", "vector", scale.alias("w"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("a.group_id") == F.col("b.group_id"))
    score = dot(F.col("a.vector"), F.col("b.vector")) * F.col("a.w") * F.col("b.w")
    return pairs.select(F.col("a.group_id").alias("group_id"), F.col("a.resp_id").alias("i"), F.col("b.resp_id").alias("j"), score.alias("score"))


def vocabulary_left(ours: DataFrame, theirs: DataFrame, n: int = 1) -> DataFrame:
    """(group_id, ngram) once for each time that ``ours`` says it more often than ``theirs`` in the group: a multiset difference of n-grams."""
    said = lambda rows: ngrams(rows, n, False).select("group_id", "ngram")
    return said(ours).exceptAll(said(theirs))


def vocabulary_shared(ours: DataFrame, theirs: DataFrame, n: int = 1) -> DataFrame:
    """(group_id, ngram) once for each time that both say it in the group."""
    said = lambda rows: ngrams(rows, n, False).select("group_id", "ngram")
    return said(ours).intersectAll(said(theirs))


def alternate_ordering(docs: Column, sample: Column) -> Column:
    """Documents in the order of sample i: as they are, both halves reversed, or all reversed, by i modulo 3."""
    middle = F.floor(F.size(docs) / 2).cast("int")
    halves = F.concat(F.reverse(F.slice(docs, F.lit(1), middle)), F.reverse(F.slice(docs, middle + 1, F.size(docs) - middle)))
    return F.when(F.size(docs) < 2, docs).when(F.pmod(sample, F.lit(3)) == 0, docs).when(F.pmod(sample, F.lit(3)) == 1, halves).otherwise(F.reverse(docs))


def repeat(rows: DataFrame, n: int, name: str = "sample") -> DataFrame:
    """Each row n times, numbered from 0."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def cluster_centroids(vectors: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """(cluster, size, centroid) of k-means over all vectors, by size ascending, then cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="f").fit(vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f")))
    sizes = model.transform(vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f"))).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("size"))
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    return sizes.join(centers, "cluster").orderBy("size", "cluster")


def largest_cluster_similarity(vectors: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """Cosine of every vector to the centroid of the largest cluster."""
    best = cluster_centroids(vectors, k, seed).orderBy(F.desc("size"), "cluster").first()
    return similarity_to(vectors, F.array(*[F.lit(x) for x in best["centroid"]]))


def eliminate_furthest(vectors: DataFrame, most: int = 4096) -> DataFrame:
    """(group_id, centroid): while over two vectors are left, the one least like the normalised centroid goes; the centroid before the last removal.

    Two vectors or fewer: the first. Groups are sets of samples of one answer; a group is one task's, the work grows with the square
    of its size, and one of over ``most`` vectors raises.
    """
    import numpy as np
    import pandas as pd

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows.sort_values("resp_id")["vector"].map(lambda x: np.asarray(x, float)).tolist())
        out = v[0]
        while len(v) > 2:
            out = v.mean(0)
            out = out / max(np.linalg.norm(out), 1e-12)
            v = np.delete(v, int((v @ out / np.maximum(np.linalg.norm(v, axis=1), 1e-12)).argmin()), 0)
        return pd.DataFrame({"group_id": [key[0]], "centroid": [out.tolist()]})

    return _bounded(vectors.select(*KEYS, "vector"), most).groupBy("group_id").applyInPandas(run, f"group_id {dict(vectors.dtypes)['group_id']}, centroid array<double>")


#: Ways to pick one of several sampled answers.
STRATEGIES = ("average_similarity", "prompting", "prompting_with_context", "bigram_consistency")


def check_strategy(strategy: str, has_model: bool) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    if "prompting" in strategy and not has_model:
        raise ValueError(f"{strategy} needs a chat model")
