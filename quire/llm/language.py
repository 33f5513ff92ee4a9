"""Language identification by bit-sliced Bloom filters of n-grams.

A filter position holds one bit a language, so that one probe of an n-gram returns a mask of all
languages that contain it. A text's counts of set bits, corrected for the false positives that each
language's filling predicts, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.kernels import U64, blocks, flat, mix
from quire.llm.sampling import remainder
from quire.plans.storage import durable

SPACE = 0x20
FOLD = np.full(256, SPACE, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
#: Positions of the filters, and probes an n-gram: 8 MiB for each 64 languages, whatever the input's size.
POSITIONS, PROBES = 1 << 20, 3


def fold(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters lower-cased, other ASCII as spaces."""
    out = FOLD[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    out[capital] += 0x20
    return out


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of 4 bytes whose second is of a word, and their texts. A space is put before and after each text."""
    n = len(off) - 1
    padded = np.full(len(data) + 2 * n, SPACE, np.uint8)
    text = np.repeat(np.arange(n), np.diff(off))
    padded[np.arange(len(data)) + 2 * text + 1] = fold(data)
    b = padded.astype(np.uint32)
    packed = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    at = np.flatnonzero(padded[1:-2] != SPACE)
    owner = np.searchsorted(off + 2 * np.arange(n + 1), at, "right") - 1
    same = owner == np.searchsorted(off + 2 * np.arange(n + 1), at + 3, "right") - 1
    return mix(packed[at[same]].astype(U64) + U64(1)), owner[same]


def places(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> U64(20 * i)) & U64(POSITIONS - 1) for i in range(PROBES)]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = flat(batch.column("text"))
        langs = batch.column("lang")
        for a, b in blocks(off, 1 << 18):
            h, owner = grams(data[off[a] : off[b]], off[a : b + 1] - off[a])
            _, first = np.unique(mix(h ^ mix(owner.astype(U64) + U64(1))), return_index=True)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(owner[first] + a)), pa.array(h[first].view(np.int64))], names=["lang", "gram"])


class LanguageFilters:
    """``bits[w, p]`` has bit l set if position p is set in the filter of language 64 * w + l."""

    def __init__(self, langs: list[str], bits: np.ndarray):
        self.langs, self.bits = langs, bits
        self.false = np.array([((bits[i // 64] >> U64(i % 64)) & U64(1)).mean() ** PROBES for i in range(len(langs))])

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected counts of n-grams, a row a text and a column a language."""
        h, owner = grams(data, off)
        at, n, found = places(h), len(off) - 1, []
        total = np.bincount(owner, minlength=n)
        for w, word in enumerate(self.bits):
            mask = np.full(len(h), ~U64(0))
            for p in at:
                mask &= word[p]
            found += [np.bincount(owner, (mask >> U64(i)) & U64(1), minlength=n) for i in range(min(64, len(self.langs) - 64 * w))]
        found = np.stack(found, 1)
        return np.maximum((found - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0)


def train_filters(docs: DataFrame, *, per_language: int = 1500, min_docs: int = 2, min_share: float = 0.1) -> LanguageFilters:
    """Filters from at most ``per_language`` documents of each language, those of least hash.

    A language contains an n-gram that at least ``min_docs`` of its documents have, and a share of them
    of at least ``min_share`` of the largest share that any language has: words of another language in
    a few texts (names, quotations, wrong labels) are no part of a language. Rows of null lang teach
    nothing; rows of one doc_id and language are taken together. Any number of languages has room.
    """
    rows = docs.where("lang is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id")
    # hashes under a bound that about twice as many rows pass first: a language's rows never meet in one task
    bound = rows.groupBy("lang").agg((F.lit(2.0 * per_language + 100) / F.count("*")).alias("share"))
    low = rows.select("lang", "h", "doc_id").join(F.broadcast(bound), "lang").where(F.shiftrightunsigned("h", 1) / F.lit(2.0**63) <= F.col("share"))
    ids = low.withColumn("key", F.shiftrightunsigned("h", 1)).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))).where(F.col("r") <= per_language).select("doc_id", "lang")
    ids = durable(ids, "language-ids")
    sizes = ids.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not sizes:
        return LanguageFilters([], np.zeros((0, POSITIONS), U64))
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["lang"], i, r["count"]) for i, r in enumerate(sizes)], "lang string, i int, n long")
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), ["doc_id", "lang"])  # at most per_language ids a language
    counts = sample.select("lang", "text").mapInArrow(_train, "lang string, gram long").groupBy("lang", "gram").count()
    share = counts.where(F.col("count") >= min_docs).join(F.broadcast(known), "lang").withColumn("share", F.col("count") / F.col("n"))
    kept = share.withColumn("top", F.max("share").over(W.partitionBy("gram"))).where(F.col("share") >= min_share * F.col("top"))
    place = F.array(*[F.shiftrightunsigned("gram", 20 * i).bitwiseAND(F.lit(POSITIONS - 1)) for i in range(PROBES)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % 64)
    cells = kept.select(F.explode(place).alias("p"), F.floor(F.col("i") / 64).cast("int").alias("w"), bit.alias("b")).groupBy("w", "p").agg(F.bit_or("b").alias("b")).toArrow()  # at most POSITIONS rows for each 64 languages
    bits = np.zeros((-(-len(sizes) // 64), POSITIONS), np.int64)
    if len(cells):
        bits[cells.column("w").to_numpy(), cells.column("p").to_numpy()] = cells.column("b").to_numpy()
    return LanguageFilters([r["lang"] for r in sizes], bits.view(U64))


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score (the language's part of all corrected counts) of every text.

    ``und`` with score 0 for null texts and texts without a letter, and where nothing was learned. A
    text of which no language has an n-gram, and ties, go to the first language by name.
    Repeated rows are judged alike; other columns are dropped.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in blocks(off, 1 << 19):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                pred, score = ["und"] * (b - a), np.zeros(b - a)
                if filters.langs:
                    c = filters.counts(d, o)
                    best = c.argmax(1)
                    score = c[np.arange(len(c)), best] / np.maximum(c.sum(1), 1e-9)
                    score = np.where(c.sum(1) > 0, np.clip(score, 0, 1), 1 / len(filters.langs))
                    folded = FOLD[d]
                    ascii_letters = np.zeros(len(d) + 1, np.int64)
                    np.cumsum((folded >= 97) & (folded < 123), out=ascii_letters[1:])
                    has = ascii_letters[o[1:]] > ascii_letters[o[:-1]]
                    for i in np.flatnonzero(~has):
                        has[i] = any(x.isalpha() for x in d[o[i] : o[i + 1]].tobytes().decode("utf-8", "ignore"))
                    pred = [filters.langs[x] if h else "und" for x, h in zip(best.tolist(), has.tolist(), strict=True)]
                    score = np.where(has, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``identify``: null, empty and letterless texts are ``und`` with score 0; rows of null doc_id are not learned from and count as not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    filters = train_filters(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
