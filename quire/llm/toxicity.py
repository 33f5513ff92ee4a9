"""Toxicity: a linear classifier of words and word beginnings, regularised by counterfactuals.

Sentences of labelled texts that name an identity are taken again with another identity of the same
kind in its place; sentences that name none are taken with one put in, which is then swapped, too.
Training penalises the square of the change in score between the two of a pair, and between a sentence
with an identity put in and without. So a mention by itself carries no score, and neutral mentions are
not rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import U64, blocks, flat, mix, owners, prefix_sums, span_hash, words
from quire.llm.language import FOLD, fold
from quire.llm.sampling import least_hashed, remainder
from quire.plans.storage import durable

LETTERS = FOLD != 0x20
LETTERS[: 0x41] = False
#: Weights of the model, and beginnings of words (bytes) that are features beside the whole word.
SIZE, BEGINNINGS = 1 << 18, (4, 5, 6, 7)
#: Texts of fewer words than this count as of so many: a rate over a few words is little evidence.
LEAST_WORDS = 12
#: Features of a model: those of most evidence, so that what reaches the driver is bounded for each sampled text.
MOST_FEATURES = 1 << 14
#: Interchangeable terms, by kind.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("gay", "straight", "lesbian", "bisexual"), ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees"), ("mexican", "american", "chinese", "african", "european", "indian"), ("transgender", "cisgender"), ("deaf", "blind", "disabled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


class _Features:
    """Word features of a block of texts: ``ids`` (words x features; SIZE where a word has no such beginning)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = fold(data)
        self.starts, self.ends, self.word_off = words(self.data, off, LETTERS)
        sums = prefix_sums(self.data)
        ids = np.full((len(self.starts), 1 + len(BEGINNINGS)), SIZE, np.int64)
        ids[:, 0] = (span_hash(sums, self.starts, self.ends) ^ U64(1)) & U64(SIZE - 1)
        for i, n in enumerate(BEGINNINGS, 1):
            longer = np.flatnonzero(self.ends - self.starts > n)
            ids[longer, i] = mix(span_hash(sums, self.starts[longer], self.starts[longer] + n) + U64(n)) & U64(SIZE - 1)
        self.ids, self.counts = ids, np.diff(self.word_off)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts, and of the toxic ones, have each feature; at most SIZE rows a task."""
    have, have1 = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for batch in batches:
        data, off = flat(batch.column("text"))
        toxic = np.array(batch.column("toxic").to_pylist(), int)
        for a, b in blocks(off):
            f = _Features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            for i in range(b - a):
                u = np.unique(f.ids[f.word_off[i] : f.word_off[i + 1]])
                have[u[u < SIZE]] += 1
                have1[u[u < SIZE]] += toxic[a + i]
    at = np.flatnonzero(have)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[at]), pa.array(have1[at])], names=["feature", "n", "n1"])


def _featurize(live: np.ndarray):
    """Each text's live features and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in blocks(off):
                f = _Features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ids, counts = [], []
                for i in range(b - a):
                    u, c = np.unique(f.ids[f.word_off[i] : f.word_off[i + 1]], return_counts=True)
                    own = live[u]
                    ids.append(u[own].astype(np.int32).tobytes())
                    counts.append(c[own].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "toxic", "fold")), pa.array(f.counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "fold", "n", "ids", "counts"])

    return run


def _sentences(text: str) -> Iterator[list[str]]:
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        if tokens := re.findall(r"[^\W\d_]+", sentence):
            yield tokens


def _carriers(identities: Sequence[Sequence[str]], each: int):
    """Of each text, the ``each`` sentences of least hash that name an identity, and as many of 3 to 40 words that name none."""
    terms = {t for k in identities for t in k}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                own: tuple[dict, dict] = ({}, {})
                for tokens in _sentences(text or ""):
                    names = not terms.isdisjoint(tokens)
                    if len(tokens) <= 40 and (names or len(tokens) >= 3):
                        s = " ".join(tokens)
                        own[names][s] = zlib.crc32(s.encode())
                for names, found in enumerate(own):
                    out += [(not names, h, s) for s, h in sorted(found.items(), key=lambda x: (x[1], x[0]))[:each]]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["neutral", "h", "sentence"])

    return run


def counterfactuals(text: str, identities: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """Pairs of sentences that should score alike.

    A sentence that names an identity, with each where another of the kind is named instead. One that
    names none, and itself with an identity put in; and that with another of the kind in its place.
    Where and which follow from the sentence's crc32.
    """
    kinds = {t: k for k in identities for t in k}
    out = []
    for tokens in _sentences(text):
        named = [(i, kinds[t]) for i, t in enumerate(tokens) if t in kinds]
        for i, kind in named:
            out += [(" ".join(tokens), " ".join([*tokens[:i], other, *tokens[i + 1 :]])) for other in kind if other != tokens[i]]
        if not named and identities:
            h = zlib.crc32(" ".join(tokens).encode())
            kind = identities[h % len(identities)]
            i, first = h // 7 % (len(tokens) + 1), h // 11 % len(kind)
            with_term = [" ".join([*tokens[:i], kind[(first + k) % len(kind)], *tokens[i:]]) for k in (0, 1)]
            out += [(" ".join(tokens), with_term[0]), (with_term[0], with_term[1])]
    return out


def differences(pairs: Sequence[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and differences in rate of the features that the two sentences of each pair do not share."""
    out = []
    made = rows_of([s for p in pairs for s in p])
    for (ia, ra), (ib, rb) in zip(made[::2], made[1::2], strict=True):
        u, inv = np.unique(np.concatenate([ia, ib]), return_inverse=True)
        d = np.bincount(inv, np.concatenate([ra, -rb]), minlength=len(u))
        out.append((u[d != 0], d[d != 0]))
    return out


def rows_of(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature ids and rates of single texts, as the model sees them."""
    data, off = flat(pa.array(list(texts), pa.string()))
    f = _Features(data, off)
    out = []
    for i in range(len(texts)):
        u, c = np.unique(f.ids[f.word_off[i] : f.word_off[i + 1]], return_counts=True)
        out.append((u[u < SIZE], c[u < SIZE] * 100.0 / max(f.counts[i], LEAST_WORDS)))
    return out


class ToxicityModel:
    """score = sigmoid(scale * (margin - cut) + log(0.7 / 0.3)): the calibrated cut has score 0.7."""

    CUT_SCORE = 0.7

    def __init__(self, weights: np.ndarray, scale: float = 1.0, cut: float = 1.0, n_pairs: int = 0):
        self.weights, self.scale, self.cut, self.n_pairs = weights.astype(np.float32), scale, cut, n_pairs

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        f = _Features(data, off)
        w = np.append(self.weights, np.float32(0))[f.ids].sum(1)
        return np.bincount(owners(f.word_off), w, minlength=len(off) - 1) * 100.0 / np.maximum(f.counts, LEAST_WORDS)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        x = self.scale * (margins - self.cut) + np.log(self.CUT_SCORE / (1 - self.CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(ids: list[np.ndarray], rates: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]] = (), *, kept_out: np.ndarray | None = None, penalty: float = 10.0, ridge: float = 1e-4, rounds: int = 200, evidence: float = 10.0) -> ToxicityModel:
    """Logistic regression by Adam over all rows at once, then a cut of best F1 on the rows kept out (by default each fifth).

    ``pairs``: ids and differences in rate between a sentence and its counterfactual.
    """
    kept_out = np.arange(len(toxic)) % 5 == 4 if kept_out is None else kept_out
    train = np.flatnonzero(~kept_out) if (~kept_out & toxic).any() and (~kept_out & ~toxic).any() else np.arange(len(toxic))
    col = np.concatenate([ids[i] for i in train])
    row = np.repeat(np.arange(len(train)), [len(ids[i]) for i in train])
    x = np.concatenate([rates[i] for i in train]).astype(np.float32)
    live = (association(np.bincount(col, minlength=SIZE), np.bincount(col, toxic[train][row], minlength=SIZE), len(train), int(toxic[train].sum())) >= evidence)[col]
    names, col = np.unique(col[live], return_inverse=True)
    row, x, y = row[live], x[live], toxic[train].astype(float)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    pair_row = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs]) if len(pairs) else np.zeros(0, int)
    pair_id = np.concatenate([p[0] for p in pairs]) if len(pairs) else np.zeros(0, int)
    pair_x = np.concatenate([p[1] for p in pairs]) if len(pairs) else np.zeros(0)
    at = np.searchsorted(names, pair_id)
    known = np.isin(pair_id, names)
    pair_row, pair_x, at = pair_row[known], pair_x[known], at[known]
    w, m, v, bias, mb, vb = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, x * w[col], minlength=len(train)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        grad = np.bincount(col, x * g[row], minlength=len(names)) + ridge * w
        if len(pair_x):
            change = np.bincount(pair_row, pair_x * w[at], minlength=len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(at, pair_x * change[pair_row], minlength=len(names))
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(SIZE)
    weights[names] = w
    margins = np.array([(weights[i] * r).sum() for i, r in zip(ids, rates, strict=True)])
    check = kept_out if (kept_out & toxic).sum() >= 5 else np.ones(len(toxic), bool)
    return ToxicityModel(weights, 1.0, best_cut(margins[check], toxic[check]), len(pairs))


def association(have: np.ndarray, have1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """For each feature, which so many texts and so many toxic ones have, the likelihood-ratio statistic of its presence against the label."""
    have, out = have.astype(float), np.zeros(SIZE)
    for seen, total in ((have1, n1), (have - have1, n - n1)):
        for k, all_k in ((seen, have), (total - seen, n - have)):
            expected = all_k * total / n
            out += np.where(k > 0, 2 * k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def best_cut(margins: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap between two neighbours that gives the best F1."""
    order = np.argsort(-margins, kind="stable")
    s, hit = margins[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(toxic.sum(), 1))
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def train_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, carriers: int = 2000, identities: Sequence[Sequence[str]] = IDENTITIES, penalty: float = 10.0, evidence: float = 10.0) -> ToxicityModel | None:
    """A model from at most ``per_class`` labelled documents of each label, those of least hash.

    Counterfactuals are made of at most ``carriers`` of their sentences, those that name an identity
    before others. Null labels and null ids are left out, null texts are empty, a document with several
    labels or rows counts with each; None if one of the labels has no document.
    """
    marked = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").distinct()
    ids = least_hashed(marked.where("toxic = 1"), per_class, "doc_id").unionByName(least_hashed(marked.where("toxic = 0"), per_class, "doc_id"))
    sample = docs.select("doc_id", "text").join(F.broadcast(durable(ids, "toxicity-ids")), "doc_id")  # at most 2 * per_class ids
    sample = durable(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int")), "toxicity-sample")
    types = dict(sample.dtypes)
    learned = sample.where("fold <> 4")
    n, n1 = learned.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = learned.mapInArrow(_presence, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).toArrow()  # at most SIZE rows
    have, have1, live = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE + 1, bool)
    have[seen.column("feature").to_numpy()], have1[seen.column("feature").to_numpy()] = seen.column("n").to_numpy(), seen.column("n1").to_numpy()
    strength = association(have, have1, n, n1) if n1 and n1 < n else np.zeros(SIZE)
    best = np.argsort(-strength, kind="stable")[:MOST_FEATURES]
    live[best[strength[best] >= evidence]] = True
    got = sample.mapInArrow(_featurize(live), f"doc_id {types['doc_id']}, toxic {types['toxic']}, fold int, n long, ids binary, counts binary").orderBy("doc_id", "toxic", "n", "ids", "counts").toArrow()
    toxic = np.array(got.column("toxic").to_pylist(), int) == 1
    if not toxic.any() or toxic.all():
        return None
    found = [np.frombuffer(x.as_py(), np.int32) for x in got.column("ids")]
    rates = [np.frombuffer(x.as_py(), np.float32) * (100.0 / max(n.as_py(), LEAST_WORDS)) for x, n in zip(got.column("counts"), got.column("n"), strict=True)]
    sentences = sample.select("text").mapInArrow(_carriers(identities, 4), "neutral boolean, h long, sentence string").distinct()
    chosen = [r["sentence"] for r in sentences.orderBy("neutral", "h", "sentence").limit(carriers).collect()]  # from at most 8 a sampled row
    pairs = differences([p for s in chosen for p in counterfactuals(s, identities)])
    return fit(found, rates, toxic, pairs, kept_out=got.column("fold").to_numpy() == 4, penalty=penalty, evidence=evidence)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, score and predicted (1 from a score of 0.7) of every text.

    Null and empty texts have the score of a text without evidence; without a model all scores are 0.
    Repeated rows are scored alike; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in blocks(off, 1 << 19):
                score = model.scores(model.margins(data[off[a] : off[b]], off[a : b + 1] - off[a])) if model else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score), pa.array((score >= ToxicityModel.CUT_SCORE).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is not predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            keep = np.ones(len(batch), bool)
            for a, b in blocks(off, 1 << 19):
                if model:
                    keep[a:b] = model.scores(model.margins(data[off[a] : off[b]], off[a : b + 1] - off[a])) < ToxicityModel.CUT_SCORE
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out_fold():
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``score_toxicity``: null and empty texts have the score of no evidence, repeated rows score alike, a null doc_id is not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train_toxicity(docs, labels.where(~held_out_fold()))
    return score_toxicity(docs, model).select("doc_id", held_out_fold().alias("held_out"), "score", "predicted")
