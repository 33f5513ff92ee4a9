"""Whitening against a full eigendecomposition in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string"


def brute(rows, k=4):
    """By full decomposition: rows of (vec_id, component, n, deviation, |whitened|, explained)."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array(fit, float) - np.array([t / n for t in s])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    e, u = e[e > 1e-10 * e[0]], u[:, e > 1e-10 * e[0]]
    w = [np.abs((np.array(x) - np.array([t / n for t in s])) @ u / np.sqrt(e)) for _, x in kept]
    return [(i, j + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), w[r][j], e[j] / np.trace(c.T @ c / n)) for r, (i, x) in enumerate(kept) for j in range(len(e))]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)
    vectors = whitening.integer_vectors(df)
    return whitening.whiten(vectors, whitening.fit_components(whitening.distinct_vectors(vectors), **how)).collect()


def agree(got, want):
    key = lambda r: (repr(r[0]), r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(abs(g[4]) - w[4]) < 1e-7 * (1 + w[4]) and abs(g[5] - w[5]) < 1e-10 and g[6] < 1e-9 for g, w in zip(got, want, strict=True))


def test_whitening(spark):
    rnd = random.Random(5)
    common = [rnd.gauss(0, 1) for _ in range(20)]
    rows = [(i, [rnd.gauss(0, 1 + 3 / (j + 1)) for j in range(20)]) for i in range(400)] + [(1000 + i, common) for i in range(300)]
    rows += [(2000, None), (2001, [None] * 20), (2002, [math.nan] + common[1:]), (2003, [math.inf] + common[1:]), (2004, []), (None, common), (5, common), (5, common)]
    got = run(spark, rows)
    agree(got, brute(rows))
    signs = {}
    for r in got:
        if r.vec_id == 1000 or r.vec_id == 1299:
            signs.setdefault(r.component, set()).add(r.whitened)
    assert all(len(s) == 1 for s in signs.values())


def test_few_and_flat_vectors(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == []
    line = [(i, [i / 8, i / 4, -i / 2]) for i in range(9)]
    agree(run(spark, line), brute(line))
    assert {r.component for r in run(spark, line)} == {1}
    agree(run(spark, [(1, [0.5]), (2, [1.5]), (3, [0.5])]), brute([(1, [0.5]), (2, [1.5]), (3, [0.5])]))


def test_rows_of_another_size_are_dropped(spark):
    rows = [(i, [math.sin(i), math.cos(i * i)]) for i in range(20)]
    agree(run(spark, [*rows, (99, [1.0, 2.0, 3.0])]), brute(rows))


def test_more_components_than_asked_dimensions(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(200)]) for i in range(300)]
    agree(run(spark, rows, k=3), brute(rows, 3))


def test_close_eigenvalues(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1 - 1e-3 * j) for j in range(40)]) for i in range(3000)]
    agree(run(spark, rows), brute(rows))


def test_numbers_beyond_64_bits_raise(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e18]), (2, [-1e18]), (3, [1e17])])


def test_query(spark, sf_dir):
    got = whitening.op11_whitening(spark, sf_dir).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding")).collect()]
    agree(got, brute(rows))
