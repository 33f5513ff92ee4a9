"""Substring deduplication by a suffix array of the places that can repeat.

Every window of ``LENGTH`` bytes holds an anchor: the place of its least hashed ``GRAM`` bytes. Two
equal windows hold the same anchor at the same offset, so only suffixes that start at anchors need to
be put in order. A chunk of documents sends, for each anchor, a hash of its gram and one of the
fragment around it that all windows with the anchor lie in. Where a gram has one fragment, the
documents' order decides. Where it has several, one copy of each fragment goes on: chunks exchange
them as sorted, front-coded runs of suffixes, and a loser tree merges the runs, comparing from the
known common prefixes on. Which windows of the fragments agree follows from the common prefixes to the
right of the anchor and the bytes to the left of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.exchange import bucket_slices, chunked, pack, pack_keys, parts_of, unpack, unpack_keys
from quire.llm.kernels import U64, blocks, flat, mix, prefix_sums, span_hash

LENGTH, GRAM = 50, 20
#: Grams in a window; bytes of a fragment before its anchor; bytes of a fragment.
SHIFTS = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
FRAGMENT = LEFT + LENGTH
#: A byte that UTF-8 never has stands beyond a text's ends.
BEYOND = 0xFF
LAST_ID = np.iinfo(np.int64).max
NOTHING, ALL, ASK = 0, 1, 2


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (or greatest) of each n consecutive values, by doubling."""
    width = 1
    while width * 2 <= n:
        x = least(x[:-width], x[width:])
        width *= 2
    return x if width == n else least(x[: len(x) - (n - width)], x[n - width :])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each anchor's text, place, gram hash and fragment hash; and the padded bytes.

    ``place`` counts in the padded bytes, where text i starts at off[i] + FRAGMENT * (i + 1).
    """
    n = len(off) - 1
    padded = np.full(len(data) + FRAGMENT * (n + 1), BEYOND, np.uint8)
    padded[np.arange(len(data)) + FRAGMENT * (np.repeat(np.arange(n), np.diff(off)) + 1)] = data
    if not len(data):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), padded)
    sums = prefix_sums(padded)
    at = np.arange(len(padded) - GRAM + 1)
    h = span_hash(sums, at, at + GRAM)
    beyond = np.zeros(len(padded) + 1, np.int64)
    np.cumsum(padded == BEYOND, out=beyond[1:])
    h[beyond[GRAM:] > beyond[: len(at)]] = ~U64(0)
    low = _slide(h, SHIFTS, np.minimum)  # of the window that starts at each place
    low[beyond[LENGTH:] > beyond[: len(low)]] = 0  # such a window is of no one text
    high = _slide(np.concatenate([np.zeros(SHIFTS - 1, U64), low, np.zeros(SHIFTS - 1, U64)]), SHIFTS, np.maximum)
    place = np.flatnonzero((high[: len(h)] == h) & (h != ~U64(0)))
    text = np.searchsorted(off[:-1] + FRAGMENT * (np.arange(n) + 1), place, "right") - 1
    # anchors are least hashes, which crowd at the low end: mixed once more, they are dealt evenly
    return text, place, mix(h[place]), span_hash(sums, place - LEFT, place + LENGTH), padded


class _Chunk:
    """A chunk's distinct (gram, fragment) pairs in order, with the least document of each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("doc_id")  # nulls come last
        self.table = table
        self.data, self.off = flat(table.column("text"))
        ids = table.column("doc_id").cast(pa.int64()).combine_chunks()
        self.ids = np.where(np.asarray(ids.is_null()), LAST_ID, np.asarray(ids.fill_null(0)))
        parts = []
        for a, b in blocks(self.off, 1 << 18):
            text, place, h, f, padded = anchors(self.data[self.off[a] : self.off[b]], self.off[a : b + 1] - self.off[a])
            start = place - (FRAGMENT * (text + 1)) + self.off[a]  # in the chunk's bytes
            parts.append((text + a, start, h, f))
        self.text, self.start, h, f = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        order = np.lexsort((self.text, f, h))
        h, f = h[order], f[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        self.h, self.f, self.least = h[first], f[first], self.ids[self.text[order[first]]]
        self.example = order[first]  # an occurrence in that document
        self.entry = np.empty(len(h), np.int64)  # of each occurrence
        self.entry[order] = np.cumsum(first) - 1

    def fragments(self, entries: np.ndarray) -> np.ndarray:
        """The bytes of fragments, a row each."""
        x = self.example[entries]
        at = self.start[x][:, None] + np.arange(-LEFT, LENGTH)
        inside = (at >= self.off[self.text[x]][:, None]) & (at < self.off[self.text[x] + 1][:, None])
        return np.where(inside, self.data[np.clip(at, 0, max(len(self.data) - 1, 0))], BEYOND).astype(np.uint8)


def _keys(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        rows = []
        for b, s in bucket_slices(c.h, buckets):
            ids, which = np.unique(c.least[s], return_inverse=True)
            rows.append((b, key[0].as_py(), pack_keys(c.h[s]), pack(c.f[s]), pack_keys(ids.view(U64)), pack(which.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32))))
        return _table(rows, ("bucket", "chunk", "grams", "fragments", "ids", "which"), (pa.int64(), pa.int64(), *[pa.binary()] * 4))

    return run


def _table(rows: list[tuple], names, types) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)})


def _decide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Answers each run: does an earlier document have the fragment, does none, or must fragments be compared?"""
    n = len(table)
    h = [unpack_keys(x.as_py()) for x in table.column("grams")]
    width = [unpack(x.as_py(), np.uint16 if x.as_py()[0] == 2 else np.uint32) for x in table.column("which")]
    least = np.concatenate([unpack_keys(x.as_py()).view(np.int64)[w.astype(np.int64)] for x, w in zip(table.column("ids"), width, strict=True)])
    f = np.concatenate([unpack(x.as_py(), U64) for x in table.column("fragments")])
    cuts = np.cumsum([len(x) for x in h])[:-1]
    h = np.concatenate(h)
    order = np.lexsort((least, f, h))
    hs, fs, ds = h[order], f[order], least[order]
    new_f = np.ones(len(hs), bool)
    new_f[1:] = (hs[1:] != hs[:-1]) | (fs[1:] != fs[:-1])
    gram = np.cumsum(np.append(True, hs[1:] != hs[:-1])) - 1
    many = np.bincount(gram, new_f)[gram] > 1
    leader = ds[np.maximum.accumulate(np.where(new_f, np.arange(len(hs)), 0))]
    says = np.where(ds > leader, ALL, np.where(many & new_f, ASK, NOTHING)).astype(np.uint8)
    # rows of one document in two chunks can tie for the least: each of them is judged like the first
    tie = ~new_f & (ds == leader) & many
    says[tie] = ASK
    out = np.empty_like(says)
    out[order] = says
    return pa.table({"chunk": table.column("chunk"), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "says": pa.array([pack(x) for x in np.split(out, cuts)], pa.binary())})


def _answers(table: pa.Table, column: str, dtype) -> np.ndarray:
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    got = table.column(column).take(pa.array(order))
    return np.concatenate([unpack(x.as_py(), dtype) for x in got]) if len(got) else np.zeros(0, dtype)


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted rows of bytes as their common prefixes with the row before and the bytes that differ."""
    same = rows[1:] == rows[:-1]
    common = np.zeros(len(rows), np.uint8)
    common[1:] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return pack(common), pack(rows[np.arange(rows.shape[1]) >= common[:, None]])


def front_decode(common: bytes, rest: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    common, rest = unpack(common, np.uint8), unpack(rest, np.uint8)
    out = np.zeros((len(common), width), np.uint8)
    own = np.arange(width) >= common[:, None]
    out[own] = rest
    last = np.maximum.accumulate(np.where(own, np.arange(len(common))[:, None], 0), axis=0)
    return out[last, np.arange(width)], common


def merge_runs(runs: list[tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs (suffixes, common prefix with the one before) by a loser tree.

    A node of the tree keeps the loser of its match with the common prefix of loser and winner. The next
    suffix of the winner's run meets each loser with both common prefixes to the last output known: if
    they differ, the longer wins without a look at the bytes; if not, bytes are compared from there on.
    Returns the run and the index in it of each suffix in order, and its common prefix with the one before.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    width = max((len(r[0][0]) for r in runs if len(r[0])), default=0)
    at = [0] * size
    texts = [r[0] for r in runs] + [[]] * (size - k)
    commons = [r[1].tolist() for r in runs] + [[]] * (size - k)
    done = None  # the player of an empty run: (run, common prefix with the last output)

    def play(a, b):
        """(winner, loser) of two players (run, common prefix with the last output); the loser's prefix becomes that with the winner."""
        if a is done:
            return b, a
        if b is done:
            return a, b
        (i, x), (j, y) = a, b
        if x > y:
            return a, b
        if y > x:
            return b, a
        s, t = texts[i][at[i]], texts[j][at[j]]
        while x < width and s[x] == t[x]:
            x += 1
        if x == width or s[x] < t[x]:
            return a, (j, x)
        return b, (i, x)

    loser = [done] * size
    players = [(i, 0) if len(texts[i]) else done for i in range(size)]
    while len(players) > 1:
        half = len(players) // 2
        level = []
        for m in range(half):
            w, lost = play(players[2 * m], players[2 * m + 1])
            loser[half + m] = lost
            level.append(w)
        players = level
    best = players[0]
    out_run, out_at, out_common = [], [], []
    while best is not done:
        i, common = best
        out_run.append(i)
        out_at.append(at[i])
        out_common.append(common)
        at[i] += 1
        best = (i, commons[i][at[i]]) if at[i] < len(texts[i]) else done
        node = (size + i) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2
    return np.array(out_run, np.int64), np.array(out_at, np.int64), np.array(out_common, np.int64)


def _ask(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(docs)
        ask = np.flatnonzero(_answers(answers, "says", np.uint8) == ASK)
        rows = []
        for b, s in bucket_slices(c.h[ask], buckets):
            e = ask[s]
            whole = c.fragments(e)
            suffix = np.concatenate([whole[:, LEFT:], whole[:, LEFT - 1 :: -1][:, :LEFT]], 1)  # to the right of the anchor, then to its left, outwards
            order = np.lexsort(suffix.T[::-1])
            common, rest = front_code(suffix[order])
            rows.append((b, key[0].as_py(), common, rest, pack(np.argsort(order).astype(np.uint32)), pack(c.least[e[order]])))
        return _table(rows, ("bucket", "chunk", "common", "rest", "place", "least"), (pa.int64(), pa.int64(), *[pa.binary()] * 4))

    return run


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Answers each fragment with a bit for each of its windows that an earlier document has; bit a: the window that starts a bytes before the anchor."""
    decoded = [front_decode(x.as_py(), y.as_py(), FRAGMENT) for x, y in zip(table.column("common"), table.column("rest"), strict=True)]
    least = [unpack(x.as_py(), np.int64) for x in table.column("least")]
    runs = [([r.tobytes() for r in rows], common) for rows, common in decoded]
    run, at, common = merge_runs(runs)
    starts = np.cumsum([0, *(len(r[0]) for r in runs)])
    order = starts[run] + at
    rows = np.concatenate([d[0] for d in decoded])[order]
    ids = np.concatenate(least)[order]
    mask = np.zeros(len(rows), np.uint32)
    outward = np.zeros((LEFT + 1, len(rows)), U64)  # hashes of the a bytes to the left
    for a in range(1, LEFT + 1):
        outward[a] = mix(outward[a - 1] * U64(0x9E3779B97F4A7C15) + rows[:, LENGTH + a - 1].astype(U64) + U64(1))
    for a in range(LEFT + 1):
        right = LENGTH - a
        group = np.cumsum(common < right)  # suffixes that share their first bytes stand together
        valid = (rows[:, right - 1] != BEYOND) & ((rows[:, LENGTH + a - 1] != BEYOND) if a else True)
        by = np.lexsort((ids, outward[a], group))
        g, o, d = group[by], outward[a][by], ids[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        first = d[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        mask[by] |= ((d > first) & valid[by]).astype(np.uint32) << np.uint32(a)
    back = np.empty(len(rows), np.uint32)
    back[order] = mask
    masks = [pack(back[starts[i] : starts[i + 1]][unpack(p.as_py(), np.uint32)]) for i, p in enumerate(table.column("place"))]
    return pa.table({"chunk": table.column("chunk"), "bucket": pa.array([key[0].as_py()] * len(table), pa.int64()), "masks": pa.array(masks, pa.binary())})


def removed_bytes(c: _Chunk, says: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A flag for each byte of the chunk."""
    mask = np.zeros(len(c.h), np.uint32)
    mask[says == ASK] = masks
    of = mask[c.entry]
    full = np.uint32((1 << SHIFTS) - 1)
    later = c.ids[c.text] > c.least[c.entry]
    of = np.where((says[c.entry] == ALL) | later, full, of)
    edge = np.zeros(len(c.data) + 1, np.int32)
    for a in range(SHIFTS):
        start = c.start[(of >> np.uint32(a)) & 1 > 0] - a
        own = c.text[(of >> np.uint32(a)) & 1 > 0]
        fits = (start >= c.off[own]) & (start + LENGTH <= c.off[own + 1])
        np.add.at(edge, start[fits], 1)
        np.add.at(edge, start[fits] + LENGTH, -1)
    return np.cumsum(edge)[:-1] > 0


OUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(key: tuple[pa.Scalar, ...], docs: pa.Table, both: pa.Table) -> pa.Table:
    c = _Chunk(docs)
    is_mask = np.asarray(both.column("says").is_null())
    says = _answers(both.filter(pa.array(~is_mask)), "says", np.uint8)
    gone = removed_bytes(c, says, _answers(both.filter(pa.array(is_mask)), "masks", np.uint32))
    sums = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=sums[1:])
    begins = gone & ~np.append(False, gone[:-1])
    begins[c.off[:-1][c.off[:-1] < len(gone)]] |= gone[c.off[:-1][c.off[:-1] < len(gone)]]
    spans = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(begins, out=spans[1:])
    kept = [c.data[a:b][~gone[a:b]].tobytes() for a, b in zip(c.off[:-1].tolist(), c.off[1:].tolist(), strict=True)]
    return pa.table({
        "doc_id": c.table.column("doc_id"), "n_bytes": pa.array(np.diff(c.off)), "n_removed": pa.array(sums[c.off[1:]] - sums[c.off[:-1]]),
        "n_spans": pa.array(spans[c.off[1:]] - spans[c.off[:-1]]), "kept": pa.array(kept, pa.binary()),
    })


def deduplicate_substrings(docs: DataFrame) -> DataFrame:
    """Every whole text without the bytes covered by a ``LENGTH``-byte string that also starts in a document of smaller doc_id.

    Texts are UTF-8 bytes; nulls are empty. Strings are judged on the input, overlaps count, and matches
    do not cross documents. Rows of one doc_id do not count against each other; a null doc_id is later
    than all others. Other columns are dropped. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes). doc_id is of a whole-number type, as its order decides.
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be of a whole-number type")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, buckets = parts_of(total)
    parts = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chunks)
    keys = parts.groupBy("chunk").applyInArrow(_keys(buckets), "bucket long, chunk long, grams binary, fragments binary, ids binary, which binary")
    says = keys.groupBy("bucket").applyInArrow(_decide, "chunk long, bucket long, says binary")
    runs = parts.groupBy("chunk").cogroup(says.groupBy("chunk")).applyInArrow(_ask(buckets), "bucket long, chunk long, common binary, rest binary, place binary, least binary")
    masks = runs.groupBy("bucket").applyInArrow(_compare, "chunk long, bucket long, masks binary")
    both = says.withColumn("masks", F.lit(None).cast("binary")).unionByName(masks.withColumn("says", F.lit(None).cast("binary")))
    return parts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_cut, f"doc_id long, {OUT}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``deduplicate_substrings``: null and empty texts have no bytes, rows of one doc_id leave each other alone, a null doc_id is last."""
    out = deduplicate_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
