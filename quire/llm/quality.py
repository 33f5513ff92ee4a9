"""Quality rules: statistics of texts, fixed limits on them, and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import NONSPACE, U64, blocks, flat, mix, owners, prefix_sums, span_hash, windows, words
from quire.llm.sampling import least_hashed
from quire.plans.storage import durable

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Statistics that one forest looks at together (columns of features), each with a threshold of its own.
GROUPS = ((1,), (0, 1), (2, 3))


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of flat bytes."""
    n = len(off) - 1
    starts, ends, word_off = words(data, off, NONSPACE)
    sums = prefix_sums(data)
    out = {"n_words": np.diff(word_off), "word_chars": _sums(NONSPACE[data] & ((data & 0xC0) != 0x80), off)}
    out["n_symbols"] = _sums(SYMBOLS[data], off)

    # lines: between newlines and text ends
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    own = np.repeat(np.arange(n), np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1)
    line_ends = np.empty_like(line_starts)
    last = np.flatnonzero(np.append(own[1:] != own[:-1], True)) if len(own) else np.zeros(0, np.int64)
    line_ends[:-1] = line_starts[1:] - 1
    line_ends[last] = off[1:]
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    s, e, own = line_starts[full], line_ends[full], own[full]
    _, first = np.unique(mix(span_hash(sums, s, e) ^ mix(own.astype(U64) + U64(1))), return_index=True)
    out["n_lines"] = np.bincount(own, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(own[first], minlength=n)

    # words in windows of three that are found again
    word_owner = owners(word_off)
    grams = windows(span_hash(sums, starts, ends), 3)
    repeated = np.zeros(len(starts), bool)
    if len(grams):
        at = np.flatnonzero(word_owner[:-2] == word_owner[2:])
        key = mix(grams[at] ^ mix(word_owner[at].astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for i in range(3):
            repeated[at[twice] + i] = True
    out["n_repeat_words"] = np.bincount(word_owner[repeated], minlength=n)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = flat(batch.column("text"))
        for a, b in blocks(off):
            got = statistics(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=["doc_id", *COUNTS])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the counts, a row a document: characters a word, symbols a character, repeated lines, repeated words."""
    n, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([c["word_chars"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / n], 1)


class IsolationForest:
    """Trees of random splits as arrays: node i of a tree has children 2i+1 and 2i+2.

    A point's score is 2**(-mean path length / c(sample)), which is near 1 for points that few splits
    set apart.
    """

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 32, seed: int = 1):
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, size), np.int32)
        self.split = np.full((trees, size), np.inf)
        self.length = np.zeros((trees, size))
        self.norm = self._average(sample)
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), sample, replace=False)], rng)

    @staticmethod
    def _average(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng) -> None:
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(wide):
            self._leaf(t, node, depth, depth + self._average(len(rows)))
            return
        f = int(rng.choice(wide))
        at = rng.uniform(low[f], high[f])
        left = rows[:, f] < at
        self.feature[t, node], self.split[t, node] = f, at
        for child, part in ((2 * node + 1, rows[left]), (2 * node + 2, rows[~left])):
            if len(part):
                self._grow(t, child, depth + 1, part, rng)
            else:
                self._leaf(t, child, depth + 1, depth + 1)

    def _leaf(self, t: int, node: int, depth: int, length: float) -> None:
        """All below a leaf has its length: points go left to the full depth."""
        while True:
            self.length[t, node] = length
            if depth == self.depth:
                return
            node, depth = 2 * node + 1, depth + 1

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.split)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, self.feature[t, node]] >= self.split[t, node])
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.split) / max(self.norm, 1e-9))


#: Steps of a score: thresholds are found from the number of rows at each, over all rows.
LEVELS = 1 << 16


def levels(forest: IsolationForest, rows: np.ndarray) -> np.ndarray:
    return np.minimum(forest.scores(rows) * LEVELS, LEVELS - 1).astype(np.int32)


def threshold(good: np.ndarray, bad: np.ndarray, lost: float, least: float) -> float:
    """Half way between the level that at most the share ``lost`` of good rows is over, and that which nine in ten of the bad rows over it reach.

    ``good`` and ``bad`` are numbers of rows at each level. So a good text that differs a little from all good rows seen is left
    alone. Infinite if under the share ``least`` of bad rows is over the first of the two: the scores can't tell them.
    """
    if not good.sum() or not bad.sum():
        return float("inf")
    low = int(np.searchsorted(np.cumsum(good), max(1, int(np.ceil(good.sum() * (1 - lost))))))
    over = np.cumsum(np.where(np.arange(len(bad)) > low, bad, 0))
    return (low + int(np.searchsorted(over, over[-1] // 10, side="right"))) / 2 if over[-1] > least * bad.sum() else float("inf")


def calibrated_forests(known: DataFrame, trees: int, lost: float, least: float, of_tree: int = 32) -> list[tuple[tuple[int, ...], IsolationForest, float]]:
    """A forest a group, grown on rows of one half of the documents, with the threshold that all rows of the other half set; groups that find nothing new are left out.

    A tree of an isolation forest is grown on ``of_tree`` rows: those of ``trees`` trees, of least hash, and the numbers of rows at
    each level are all that leaves the executors.
    """
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    grown = least_hashed(known.where(half), trees * of_tree, "doc_id", "quality", *COUNTS).toArrow()
    if len(grown) < 2:
        return []
    rows = features({c: grown.column(c).to_numpy() for c in COUNTS})
    forests = [IsolationForest(rows[:, group], trees, of_tree) for group in GROUPS]
    names = [f"level{i}" for i in range(len(GROUPS))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = features({k: batch.column(k).to_numpy() for k in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(levels(f, of[:, g])) for f, g in zip(forests, GROUPS, strict=True))], names=["quality", *names])

    left = durable(known.where(~half).select(F.col("quality").cast("int").alias("quality"), *COUNTS).mapInArrow(score, "quality int, " + ", ".join(f"{n} int" for n in names)), "quality-levels")
    out = []
    for group, forest, name in zip(GROUPS, forests, names, strict=True):
        at = left.groupBy(name).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")).toArrow()
        numbers = np.zeros((2, LEVELS), np.int64)
        for n, kind in zip(numbers, ("good", "bad"), strict=True):
            n[at.column(name).to_numpy()] = at.column(kind).to_numpy()
        most = threshold(*numbers, lost, least)
        if np.isfinite(most):
            out.append((group, forest, most))
            left = left.where(F.col(name) <= most)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, trees: int = 100, lost: float = 0.002, least: float = 0.05) -> DataFrame:
    """Rule statistics of every text, the fixed rules' verdict and whether the text is kept.

    Words are runs of characters other than white space. ``base_failed``: fewer than 50 words, or more
    than half of them in windows of three words that the text repeats. Of the others, those stay whose
    isolation score is at most the threshold in each of the forests (one for each of ``GROUPS`` that
    finds what those before do not). Their thresholds are set by all labelled rows of half the documents, as
    far as these pass the fixed rules; their trees draw a few rows each from the other half. Without labelled rows of both kinds the forests reject nothing.

    Null text has no words and no lines. Repeated rows are judged alike; labels that are null are left
    out and several labels of one document count one by one; other columns are dropped.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly
    (the greatest score minus its threshold; null without forests).
    """
    types = dict(docs.dtypes)
    counted = docs.select("doc_id", "text").mapInArrow(_count, f"doc_id {types['doc_id']}, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = durable(counted, "quality-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marked = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    known = durable(counted.where(~failed).join(marked, "doc_id"), "quality-known")
    forests = calibrated_forests(known, trees, lost, least)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features({k: batch.column(k).to_numpy() for k in COUNTS})
            over = [(levels(f, rows[:, g]) - most) / LEVELS for g, f, most in forests]
            anomaly = pa.array(np.max(over, axis=0)) if over else pa.nulls(len(batch), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, anomaly], names=[*batch.schema.names, "anomaly"])

    judged = counted.mapInArrow(judge, ", ".join(f"{k} {t}" for k, t in counted.dtypes) + ", anomaly double")
    kept = ~failed & (F.coalesce("anomaly", F.lit(0.0)) <= 0)
    return judged.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), kept.alias("kept"), "anomaly")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``quality_rules``: null and empty texts have no words and fail the fixed rules, repeated rows are judged alike."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
