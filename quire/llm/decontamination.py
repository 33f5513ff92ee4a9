"""Benchmark decontamination by winnowing.

Every window of ``w`` consecutive k-grams of words keeps its least hash, on both sides alike; so a
shared span of at least k+w-1 words shares a kept fingerprint. Fingerprints are joined on their hash
and each hit is extended over the words around it, which are compared exactly. An item of fewer than
``WINDOW`` words is matched as a whole: with all of its words as one k-gram and w=1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.kernels import ALNUM, LOWER, U64, blocks, flat, mix, owners, prefix_sums, span_hash, windows, words
from quire.plans.storage import durable

WINDOW, GRAM = 10, 5
#: Bits of the filter of benchmark fingerprints that is sent to all tasks: about 16 a fingerprint, from 128 KiB to 16 MiB.
#: A larger benchmark (over 8 million fingerprints) fills it more: more fingerprints pass, and the exact join removes them.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _kept(hashes: np.ndarray, owner: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of k-grams that are least in some window of w, and their hashes; ties are all kept."""
    grams = windows(hashes, k)
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64), grams
    inside = owner[:n] == owner[k - 1 :]
    if w == 1:
        at = np.flatnonzero(inside)
        return at, grams[at]
    top = ~U64(0)
    padded = np.full(n + 2 * (w - 1), top)
    padded[w - 1 : w - 1 + n] = np.where(inside, grams, top)
    m = n + w - 1
    least = padded[:m].copy()
    for i in range(1, w):  # windows that reach over a text's end only add fingerprints
        np.minimum(least, padded[i : i + m], out=least)
    most = least[:n].copy()
    for i in range(1, w):
        np.maximum(most, least[i : i + n], out=most)
    at = np.flatnonzero(inside & (most == padded[w - 1 : w - 1 + n]))
    return at, grams[at]


class _Text:
    """Words and word hashes of a block of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, self.word_off = words(self.data, off, ALNUM)
        self.owner = owners(self.word_off)
        self.hashes = span_hash(prefix_sums(self.data), self.starts, self.ends)
        self.bytes = self.data.tobytes()

    def joined(self, i: int, j: int) -> str:
        return " ".join(self.bytes[self.starts[x] : self.ends[x]].decode("utf-8", "replace") for x in range(i, j))


def _seed(h: np.ndarray, k: int, w: int) -> np.ndarray:
    """Keeps the schemes' hashes apart."""
    return mix(h + U64(k * 64 + w))


def _filter(items: DataFrame) -> np.ndarray:
    """Packed bits of all fingerprints; at most MOST_BITS / 64 rows reach the driver."""
    bits = LEAST_BITS
    n = items.count()
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    place = F.pmod(F.shiftrightunsigned("h", 17), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = items.select(F.floor(place / 64).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> U64(17)) % U64(8 * len(bits))
    return (bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


ITEMS = pa.schema([("item_id", pa.string()), ("h", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("item_words", pa.string())])


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = flat(batch.column("text"))
        for a, b in blocks(off):
            t = _Text(data[off[a] : off[b]], off[a : b + 1] - off[a])
            sizes = np.diff(t.word_off)
            ids = batch.column("item_id").slice(a, b - a).to_pylist()
            rows = []
            at, h = _kept(t.hashes, t.owner, GRAM, WINDOW - GRAM + 1)
            h = _seed(h, GRAM, WINDOW - GRAM + 1)
            for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                o = t.owner[p]
                if sizes[o] >= WINDOW:
                    lo, hi = max(t.word_off[o], p - WINDOW + GRAM), min(t.word_off[o + 1], p + WINDOW)
                    rows.append((ids[o], x, p - lo, WINDOW, t.joined(lo, hi)))
            for o in np.flatnonzero((sizes > 0) & (sizes < WINDOW)).tolist():
                n, p = int(sizes[o]), t.word_off[o]
                x = _seed(windows(t.hashes[p : p + n], n), n, 1).view(np.int64)[0]
                rows.append((ids[o], int(x), 0, n, t.joined(p, p + n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, ITEMS, strict=True)], schema=ITEMS)


PRINTS = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("at", pa.int32()), ("words", pa.string())]))


def _doc_prints(bits: np.ndarray, short: list[int]):
    """Counts words and keeps the fingerprints that may be of the benchmark, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in blocks(off):
                t = _Text(data[off[a] : off[b]], off[a : b + 1] - off[a])
                prints: list[list] = [[] for _ in range(b - a)]
                for k, w in [(GRAM, WINDOW - GRAM + 1), *((n, 1) for n in short)]:
                    at, h = _kept(t.hashes, t.owner, k, w)
                    h = _seed(h, k, w)
                    hit = _in_filter(bits, h)
                    around = WINDOW - k if w > 1 else 0
                    for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                        o = t.owner[p]
                        first = t.word_off[o]
                        lo, hi = max(first, p - around), min(t.word_off[o + 1], p + k + around)
                        prints[o].append((x, int(p - first), int(p - lo), t.joined(lo, hi)))
                made = pa.array([[dict(zip(("h", "pos", "at", "words"), x, strict=True)) for x in p] for p in prints], PRINTS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(t.word_off), pa.int64()), made], names=["doc_id", "n_words", "prints"])

    return run


SPANS = "key long, item_id string, first long, until long"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined fingerprints to the spans that their texts share, where these are long enough."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            d, i = r["words"].split(" "), r["item_words"].split(" ")
            k = GRAM if r["n"] >= WINDOW else r["n"]
            x, y = r["at"], r["item_at"]
            if d[x : x + k] != i[y : y + k]:
                continue  # equal hashes of different words
            lo = 0
            while lo < min(x, y) and d[x - lo - 1] == i[y - lo - 1]:
                lo += 1
            hi = k
            while x + hi < len(d) and y + hi < len(i) and d[x + hi] == i[y + hi]:
                hi += 1
            if lo + hi >= r["n"]:
                out.append((r["key"], r["item_id"], r["pos"] - lo, r["pos"] + hi))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["key", "item_id", "first", "until"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The words of documents that lie in a window of ``WINDOW`` words of a benchmark item.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased.
    An item of fewer words, but not none, is one window. Returns doc_id, n_words, n_hit (words in any
    occurrence of a window), n_items, items_sha256 (of the sorted item_ids, comma-joined) and
    contaminated. Null and empty texts have no words; an item of null id counts in n_hit and contaminated,
    but not in n_items and the list; each of several rows of one doc_id, of any type, null or not, is
    judged by itself; without items nothing is hit; other columns are dropped.
    """
    items = durable(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(_item_prints, "item_id string, h long, at int, n int, item_words string"), "decon-items",
    )
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # under WINDOW rows
    prints = durable(
        docs.select("doc_id", "text")
        .mapInArrow(_doc_prints(_filter(items), short), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, prints array<struct<h:long,pos:long,at:int,words:string>>")
        .withColumn("key", F.monotonically_increasing_id()), "decon-prints",
    )
    found = prints.select("key", F.explode("prints").alias("p")).select("key", "p.*")
    pairs = found.join(items.withColumnRenamed("at", "item_at"), "h")
    spans = durable(pairs.select("key", "pos", "at", "words", "item_id", "item_at", "n", "item_words").mapInArrow(_extend, SPANS).distinct(), "decon-spans")

    by_start = W.partitionBy("key").orderBy("first", "until")
    upto = F.max("until").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    new_words = F.greatest(F.lit(0), F.col("until") - F.greatest("first", F.coalesce(upto, F.lit(0))))
    hit = spans.select("key", "first", "until").distinct().withColumn("new", new_words).groupBy("key").agg(F.sum("new").alias("n_hit"))
    listed = spans.select("key", "item_id").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = prints.select("key", "doc_id", "n_words").join(hit, "key", "left").join(listed, "key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``benchmark_hits``: null and empty texts have no words and no hits, repeated rows each have their own."""
    return benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT k, item_id, i, n FROM doc_windows JOIN item_windows USING (n, g)),
hit_words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hits)) GROUP BY k),
listed AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (k) LEFT JOIN listed USING (k)
"""
