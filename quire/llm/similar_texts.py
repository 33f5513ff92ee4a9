"""N-gram Jaccard join by chosen paths.

A text is the set of its word 5-grams. A path starts with one of ``runs`` seeds; a set extends it by
each of its grams with probability 1/(threshold * size), by a hash of path and gram that all sets
share. Sets of a path's end are a bucket. Two sets of similarity ``threshold`` share an extension a
level on average, so that a pair stays together in a run with a fixed probability; the runs are as
many as the target recall needs. In a bucket, pairs are compared by short sketches, which no pair of
the threshold fails but with a chance far below the recall's; the linked parts of buckets are joined
into groups, and in each group all pairs are compared exactly.

A bucket too large for one task is dealt into parts that share some leaders. A set that resembles a
leader closely is linked to all that resembles it by way of the leader. The others are split again, on
places of their sketches, which are sampled grams too, so often that a pair at the threshold stays
together with the target recall; buckets that are still too large are compared part by part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.kernels import ALNUM, LOWER, U64, blocks, flat, mix, prefix_sums, span_hash, windows, words
from quire.plans.storage import durable

WORDS = 5
#: Places of a sketch, and the share of them that candidates must have in common: five deviations below 0.8.
SKETCH, ALIKE = 64, 0.55
#: Sets of a bucket that are all compared; and the share that makes a member of a larger one a near copy of its leader, which stands for it.
FEW, NEAR = 64, 0.95
#: A part of a bucket that one task compares; larger buckets are dealt into parts that share their least members.
PART, SHARED = 4096, 16
#: Places of a sketch that split a bucket together, and how many such splits there are: a pair at the threshold fails all with a chance of (1 - 0.8 ** 3) ** 14 < 0.0001.
PLACES, SPLITS = 3, 14
#: Sets of a group that are compared at once; larger groups are compared block by block.
BLOCK = 2048
#: Bits of the filter of sets that are in a group: 16 a set, from 128 KiB to 16 MiB. Fuller ones let more sets pass, which the join removes.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def runs_for(recall: float, depth: int) -> int:
    """Runs so that a pair at the threshold shares a bucket with probability ``recall``: extensions shared are a Poisson number of mean 1 a level."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def sets_of(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct word 5-grams of texts, hashed; a text of fewer words, but not none, has one gram: all of them."""
    low = LOWER[data]
    starts, ends, word_off = words(low, off, ALNUM)
    h = span_hash(prefix_sums(low), starts, ends)
    grams = windows(h, WORDS)
    out = []
    for i, j in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
        out.append(np.unique(grams[i : j - WORDS + 1] if j - i >= WORDS else windows(h[i:j], j - i) if j > i else h[:0]))
    return out


def digest(grams: np.ndarray) -> int:
    """One value for equal sets."""
    return int(mix(np.array([mix(grams).sum(dtype=U64) + U64(len(grams))], U64)).view(np.int64)[0])


def paths_of(grams: np.ndarray, seeds: np.ndarray, depth: int, threshold: float) -> np.ndarray:
    most = U64(min(int(2**64 / (threshold * len(grams))), 2**64 - 1))
    paths = seeds
    for _ in range(depth):
        h = mix(paths[:, None] ^ grams[None, :])
        i, j = np.nonzero(h <= most)
        paths = mix(h[i, j] + paths[i])
    return np.unique(paths)


_SKETCH_SEEDS = mix(np.arange(1, SKETCH + 1).astype(U64))


def sketch_of(grams: np.ndarray) -> bytes:
    """The last byte of the least hash under each of ``SKETCH`` functions."""
    least = np.full(SKETCH, ~U64(0))
    for i in range(0, len(grams), 4096):
        np.minimum(least, mix(grams[i : i + 4096, None] ^ _SKETCH_SEEDS).min(0), out=least)
    return (least & U64(255)).astype(np.uint8).tobytes()


def _sign(seeds: np.ndarray, depth: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in blocks(off):
                rows = []
                for g in sets_of(data[off[a] : off[b]], off[a : b + 1] - off[a]):
                    rows.append((digest(g), len(g), sketch_of(g), paths_of(g, seeds, depth, threshold).view(np.int64)) if len(g) else (None, 0, None, None))
                d, n, s, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.binary()), pa.array(p, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "sketch", "paths"])

    return run


def _links_in(sketches: np.ndarray, sizes: np.ndarray, threshold: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    fit = small >= threshold * large
    fit[fit] = (sketches[i[fit]] == sketches[j[fit]]).mean(1) >= ALIKE
    return fit


def _local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges that are not the least of their component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        for side in (i, j):
            np.minimum.at(new, side, least)
            np.minimum.at(new, root[side], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _link(threshold: float):
    """Members of buckets whose sketches agree, as (a, b) with the least member that links of the pack connect: at most an edge a member.

    Rows of columns path and digest are members of a dealt bucket that no shared leader stands for.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        path, part, ids, sizes, shared, dealt = (table.column(c).to_numpy() for c in ("path", "part", "digest", "n", "shared", "dealt"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        order = np.lexsort((ids, ~shared, part, path))
        path, part, ids, sizes, shared, dealt, sketches = (x[order] for x in (path, part, ids, sizes, shared, dealt, sketches))
        bucket = np.cumsum(np.append(True, (path[1:] != path[:-1]) | (part[1:] != part[:-1]))) - 1
        length = np.bincount(bucket)
        starts = np.cumsum(np.append(0, length))
        led = (length > FEW) | dealt[starts[:-1]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = [np.zeros(0, np.int64)]
        d, few = 1, np.flatnonzero(~led[bucket])
        while len(few):
            i = few[few + d < len(ids)]
            i = i[bucket[i + d] == bucket[i]]
            if not len(i):
                break
            ok = _links_in(sketches, sizes, threshold, i, i + d)
            found.append((ids[i[ok]], ids[i[ok] + d]))
            d, few = d + 1, i
        for b in np.flatnonzero(led):
            rest, label = np.arange(starts[b], starts[b + 1]), np.arange(length[b])
            told = not dealt[starts[b]]
            while len(rest):
                lead, others = rest[0], rest[1:]
                if not told and not shared[lead]:
                    left.append(rest)
                    told = True
                same = (sketches[others] == sketches[lead]).mean(1)
                near = same >= NEAR
                if near.any() or shared[lead]:  # what links a near copy is linked to the leader, whatever its size: their sketches differ in as many places more at most
                    linked = others[same >= ALIKE - (1 - NEAR)]
                else:
                    linked = others[_links_in(sketches, sizes, threshold, np.full(len(others), lead), others)]
                if len(linked):
                    joined = np.unique(label[np.append(linked, lead) - starts[b]])
                    label[np.isin(label, joined)] = joined[0]
                rest = others[~near]
            found.append((ids[starts[b] : starts[b + 1]], ids[starts[b] + label]))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        z = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        nodes, roots = _local_roots(a, z)
        at = np.concatenate(left)
        none = lambda n: pa.nulls(n, pa.int64())
        join = lambda x, y: pa.concat_arrays([x, y])
        return pa.table({"a": join(pa.array(nodes), none(len(at))), "b": join(pa.array(roots), none(len(at))), "path": join(none(len(nodes)), pa.array(path[at])), "digest": join(none(len(nodes)), pa.array(ids[at]))})

    return run


def _linked(buckets: DataFrame, sets: DataFrame, threshold: float, n: int, name: str) -> DataFrame:
    """What ``_link`` says of bucket parts (path, digest, part, shared, dealt); ``n``: about so many rows."""
    packed = buckets.join(sets.select("digest", "n", "sketch"), "digest").withColumn("pack", F.pmod(F.xxhash64("path", "part"), F.lit(max(1, n // 20_000))))
    return durable(packed.groupBy("pack").applyInArrow(_link(threshold), "a long, b long, path long, digest long"), name)


def _parts(members: DataFrame) -> DataFrame:
    """Members (path, digest, size) with parts of at most about ``PART``: (path, digest, part, parts)."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    return members.select("path", "digest", F.pmod(F.xxhash64("digest"), parts).cast("int").alias("part"), parts.alias("parts"))


def _sized(at: DataFrame) -> DataFrame:
    return at.join(at.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "path")


def candidate_links(at: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) edges that connect the sets (digest, n, sketch) whose sketches agree in a bucket of ``at`` (path, digest)."""
    members = durable(_parts(_sized(at)), "similar-members")
    n_members = members.count()
    large = members.where("parts > 1")
    pick = F.when(F.pmod(F.xxhash64("digest"), F.col("parts") * max(1, PART // SHARED)) == 0, F.col("digest"))
    shared = large.groupBy("path").agg(F.slice(F.array_sort(F.collect_set(pick)), 1, SHARED).alias("d"), F.first("parts").alias("parts"))  # about SHARED of a bucket
    shared = shared.select("path", F.explode("d").alias("digest"), "parts").select("path", "digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = members.select("path", "digest", "part", F.lit(False).alias("shared"), (F.col("parts") > 1).alias("dealt"))
    dealt = dealt.unionByName(shared.select("path", "digest", "part", F.lit(True).alias("shared"), F.lit(True).alias("dealt")))
    dealt = dealt.groupBy("path", "digest", "part").agg(F.max("shared").alias("shared"), F.first("dealt").alias("dealt")) if n_members > PART else dealt
    said = _linked(dealt, sets, threshold, n_members, "similar-edges")
    edges, left = said.where("a is not null").select("a", "b"), said.where("a is null").select("path", "digest").distinct()
    n_left = left.count() if n_members > PART else 0
    if not n_left:
        return edges

    # what no shared leader stands for is split again, on places of the sketch
    splits = [F.xxhash64("path", F.lit(r), *[F.substring("sketch", (r * PLACES + i) % SKETCH + 1, 1) for i in range(PLACES)]) for r in range(SPLITS)]
    split = left.join(sets.select("digest", "sketch"), "digest").select("digest", F.explode(F.array(*splits)).alias("path"))
    split = durable(_parts(_sized(split)), "similar-split")
    whole = split.where("parts = 1").select("path", "digest", "part")
    # and what is still together in too large a bucket is compared part by part
    other = split.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = other.select(F.xxhash64("path", F.least("part", "other"), F.greatest("part", "other")).alias("path"), "digest", F.lit(0).alias("part"))
    again = whole.unionByName(cells).distinct().withColumns({"shared": F.lit(False), "dealt": F.lit(False)})
    return edges.unionByName(_linked(again, sets, threshold, n_left * SPLITS, "similar-edges").select("a", "b").where("a is not null"))


def _grouped(bits: np.ndarray):
    """The sets of texts that may be in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            for a, b in blocks(off):
                sets = [g for g in sets_of(data[off[a] : off[b]], off[a : b + 1] - off[a]) if len(g)]
                ids = np.array([digest(g) for g in sets], np.int64)
                at = ids.view(U64) % U64(8 * len(bits))
                hit = np.flatnonzero((bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1) if len(ids) else []
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([sets[i].tobytes() for i in hit], pa.binary())], names=["digest", "grams"])

    return run


def similar(left: list[np.ndarray], right: list[np.ndarray], numerator: int = 4, denominator: int = 5) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least numerator/denominator, exactly."""
    sets = left + right
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at, minlength=len(grams)) > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    live = shared[at]
    row, at = row[live], column[at[live]]
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        inside = (at >= c) & (at < c + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[inside], at[inside] - c] = 1
        common += m[: len(left)] @ m[len(left) :].T
    common = np.rint(common).astype(np.int64)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return common * (numerator + denominator) >= numerator * sizes


def _roots(left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that links of a cell connect with each set of its sides."""
    most = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(ok, left[:, None], most).min(0))
        new_left = np.minimum(left, np.where(ok, new_right[None, :], most).min(1))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For cells of two blocks of a group: each set's linked documents in the cell, and the least set that the cell's links connect with it."""
    group, x, y, own = (table.column(c).to_numpy() for c in ("root", "x", "y", "own"))
    ids, copies = table.column("digest").to_numpy(), table.column("copies").to_numpy()
    grams = [np.frombuffer(g.as_py(), U64) for g in table.column("grams")]
    order = np.lexsort((ids, y, x, group))
    cuts = np.flatnonzero((group[order][1:] != group[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])) + 1
    out_id, out_n, out_to = [], [], []
    for cell in np.split(order, cuts):
        same = x[cell[0]] == y[cell[0]]
        left = cell if same else cell[own[cell] == x[cell[0]]]
        right = cell if same else cell[own[cell] == y[cell[0]]]
        if not len(left) or not len(right):
            continue
        ok = similar([grams[i] for i in left], [grams[i] for i in right])
        if same:
            np.fill_diagonal(ok, False)
        roots = _roots(ids[left], ids[right], ok)
        for side, other, m, to in ((left, right, ok, roots[0]), (right, left, ok.T, roots[1]))[: 1 if same else 2]:
            out_id.append(ids[side])
            out_n.append(m @ copies[other])
            out_to.append(to)
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.table({"digest": cat(out_id), "links": cat(out_n).astype(np.int64), "to": cat(out_to)})


def _filter(groups: DataFrame) -> np.ndarray:
    """Packed bits of the grouped sets; at most MOST_BITS / 64 rows reach the driver."""
    bits, n = LEAST_BITS, groups.count()
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    place = F.pmod(F.col("node"), F.lit(bits))  # a power of two divides 2**64, so the sign does not matter
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = groups.select(F.floor(place / 64).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def link_similar(docs: DataFrame, *, recall: float = 0.9999, depth: int = 3, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    Words are runs of ASCII letters and digits and of other non-ASCII characters, A-Z lower-cased; a
    text of one to four words is one gram. ``n_links``: the other documents of a Jaccard similarity of
    at least 0.8, copies included. ``class_id``: the least doc_id of all documents that links connect.
    A text without words (null, empty) has no links and is a class of its own; of rows without doc_id one
    that is alone in its class has none. Rows of one doc_id count one by one; other columns are dropped;
    an empty table gives an empty one. A pair at the threshold is missed with a chance of at most
    1 - ``recall``, and of 0.0001 more where all buckets that it shares are dealt. Copies are never expanded into pairs: they count as one set with a number.
    """
    if threshold != 0.8:
        raise ValueError("exact comparison is at 0.8")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    seeds = mix(np.arange(1, runs_for(recall, depth) + 1).astype(U64) << U64(32))
    signed = durable(docs.select("doc_id", "text").mapInArrow(_sign(seeds, depth, threshold), f"doc_id {kind}, digest long, n int, sketch binary, paths array<long>"), "similar-signed")
    sets = durable(signed.where("digest is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"), F.count("*").alias("copies"), F.min("doc_id").alias("least")), "similar-sets")

    edges = candidate_links(sets.select(F.explode("paths").alias("path"), "digest"), sets.select("digest", "n", "sketch"), threshold)
    groups = durable(components(edges), "similar-groups")
    packed = _filter(groups)
    grams = docs.select("text").mapInArrow(_grouped(packed), "digest long, grams binary").groupBy("digest").agg(F.first("grams").alias("grams"))
    large = groups.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)  # one in BLOCK of the sets at most
    n_blocks = F.coalesce(F.ceil(F.col("size") / BLOCK).cast("int"), F.lit(1))
    placed = groups.join(F.broadcast(large), "root", "left").select(F.col("node").alias("digest"), "root", n_blocks.alias("blocks"), F.pmod(F.xxhash64("node"), n_blocks).cast("int").alias("own"))
    cells = placed.join(sets.select("digest", "copies"), "digest").join(grams, "digest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("digest", "copies", "grams", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    packs = max(1, groups.count() // 500)
    cells = cells.withColumn("pack", F.pmod(F.xxhash64("root", "x", "y"), F.lit(packs)))
    linked = durable(cells.groupBy("pack").applyInArrow(_verify, "digest long, links long, to long"), "similar-linked")

    links = linked.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("digest").alias("a"), F.col("to").alias("b"))).withColumnsRenamed({"node": "digest"})
    named = sets.select("digest", "copies", "least").join(roots, "digest", "left").join(links, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    per_set = named.join(least, "root").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "digest").where("digest is not null").join(per_set, "digest").select("doc_id", "class_id", "n_links")
    return out.unionByName(signed.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def op2_similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``link_similar``: null and empty texts are classes of their own without links, repeated rows are links of each other."""
    return link_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
