"""Retrieval: exact nearest neighbours, parents of chunks, several vectors a document, look-ups and limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.plans.storage import durable

#: Queries of a task of the grid, and of these the ones that are compared at once.
QUERY_BLOCK, QUERY_PART = 32768, 8192
#: Rows of the corpus in a tile, bytes of vectors that are cut into tiles at once, and directions in which a tile is bounded.
TILE_ROWS, HELD_BYTES, AXES = 512, 1 << 25, 16
#: Of a block's pairs, the share up to which they are looked at one by one.
FEW = 1 / 32
#: Rows of the corpus in a range, about; a task of the grid holds a block of queries and streams a range.
RANGE_ROWS = 1 << 18
#: Vectors of the corpus that the rest is grouped around, so that far groups can be left out.
PIVOTS = 64
#: Bytes of the corpus's vectors that tell every query how far its neighbours are at most; and pairs that are worth a task.
SAMPLE_BYTES, TASK_PAIRS = 1 << 22, 1 << 24
#: What rounding can do to a bound, against the vectors' lengths, and to squared distances, which are compared to six places.
MARGIN, SLACK = 1e-6, 1e-5


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least values of each row, in order; ties by place."""
    k = min(k, d.shape[1])
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    less, ties = d < edge, d == edge
    keep = less | ties & (np.cumsum(ties, 1) <= k - less.sum(1, keepdims=True))
    place = np.nonzero(keep)[1].reshape(len(d), k)
    order = np.argsort(np.take_along_axis(d, place, 1), axis=1, kind="stable")
    return np.take_along_axis(place, order, 1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of doubles; a missing number is not a number, and a vector of another size has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.full((len(sizes), d), np.nan)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i in np.flatnonzero(sizes == d):
        out[i] = flat[at[i] : at[i + 1]]
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices; infinite where a number is missing."""
    d = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)
    d[np.isnan(d)] = np.inf
    return d


def _pivots(corpus: DataFrame) -> np.ndarray:
    """At most ``PIVOTS`` vectors of least hash."""
    chosen = corpus.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))).orderBy(F.xxhash64("id"), "id").select("vector").limit(PIVOTS).toArrow()
    if not len(chosen):
        return np.zeros((1, 1))
    sizes = chosen.column("vector").combine_chunks().value_lengths().to_pylist()
    d = max(set(sizes), key=sizes.count)
    m = _matrix(chosen.column("vector"), d)
    return m[~np.isnan(m).any(1)]


def _sample(cells: DataFrame, total: int, d: int) -> np.ndarray:
    """About ``SAMPLE_BYTES`` of the corpus's vectors, chosen by hash; with the pivots the only ones that pass the driver."""
    most = max(1, SAMPLE_BYTES // (8 * d))
    one_in = max(1, -(-total // most))
    chosen = cells.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("vector").limit(2 * most).toArrow()
    return _matrix(chosen.column("vector"), d) if len(chosen) else np.zeros((0, d))


def _in_cells(pivots: np.ndarray):
    """Adds to each vector the nearest pivot and the distance to it; the cell after the last is for vectors with missing numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _squared(_matrix(batch.column("vector"), pivots.shape[1]), pivots)
            nearest = d.argmin(1)
            away = np.sqrt(d[np.arange(len(d)), nearest])
            cell = np.where(np.isinf(away), len(pivots), nearest).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell), pa.array(away)], names=["id", "vector", "cell", "away"])

    return run


def _cells_of_queries(pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, least: np.ndarray, sample: np.ndarray, k: int):
    """A row for each query and each cell that may hold one of its k nearest, with a squared distance that these do not exceed.

    The k-th neighbour is no further than the k-th of a sample, nor than the far edge of any cell of k rows or more. By the
    triangle inequality nothing in a cell is nearer than its pivot less the cell's radius, or than its inner edge less the
    pivot's distance; nor is it nearer than the plane between the cell's pivot and the query's.
    """
    full, some = counts[:-1] >= k, counts > 0
    between = np.sqrt(_squared(pivots, pivots))
    lengths = np.linalg.norm(pivots, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = None
        for batch in batches:
            tiles = tiles or _Tiles(sample, np.arange(len(sample)))
            asked = _matrix(batch.column("vector"), pivots.shape[1])
            d = np.sqrt(_squared(asked, pivots))
            own = np.nan_to_num(np.linalg.norm(asked, axis=1))[:, None]
            margin = MARGIN * (1 + own + lengths)
            most = np.where(full, d + radius + margin, np.inf).min(1, keepdims=True) if full.any() else np.full((len(d), 1), np.inf)
            found = _Best(asked, k, most[:, 0] ** 2 + SLACK)
            tiles.meet(found)
            # a k-th of the sample may be a bit off by rounding; without one, the bound is the cells'
            most = np.minimum(most, np.sqrt(found.edge[:, None] + SLACK) + margin.max(1, keepdims=True))
            nearest = np.where(np.isinf(d), 0, np.maximum(np.maximum(d - radius, least - d) - margin, 0))
            home = d.argmin(1)
            apart = between[home]
            with np.errstate(invalid="ignore"):
                plane = (d**2 - np.take_along_axis(d, home[:, None], 1) ** 2) / (2 * np.where(apart > 0, apart, np.inf))
                # what rounding does to squares counts against the pivots' distance from each other
                plane -= margin + MARGIN**2 * (1 + own + lengths) ** 2 / np.where(apart > 0, apart, np.inf)
            nearest = np.where(np.isfinite(plane), np.maximum(nearest, plane), nearest)
            may = np.ones((len(d), len(pivots) + 1), bool)
            may[:, :-1] = nearest**2 <= most**2 + SLACK
            # vectors with missing numbers are infinitely far: they only matter where the others are too few
            may[:, -1] = np.isinf(most[:, 0])
            query, cell = np.nonzero(may & some)
            at = pa.array(query)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("vector").take(at), pa.array(cell.astype(np.int32)), pa.array(most[query, 0] ** 2 + SLACK)], names=["id", "vector", "cell", "edge"])

    return run


def _first(dist: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row, names in order."""
    place = _least(dist, k)
    return np.take_along_axis(dist, place, 1), names[place] if names.ndim == 1 else np.take_along_axis(names, place, 1)


def _may_be_nearer(asked: np.ndarray, rows: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(query, row) of all pairs, and a few more, that are no further than the query's edge; None if they are many or numbers are missing or huge.

    Products in single precision, each off by less than the bound on their rounding, leave out the rest.
    """
    own, other = (asked**2).sum(1), (rows**2).sum(1)
    most = np.sqrt(other.max(initial=0))
    if not (np.isfinite(own).all() and np.isfinite(edge).all() and most < 1e9 and own.max(initial=0) < 1e18):
        return None
    off = (asked.shape[1] + 4) * 2.0**-23 * (np.sqrt(own) * most + most**2) + SLACK
    least = ((own - edge) / 2 - off).astype(np.float32)
    product = np.column_stack([asked, np.ones(len(asked))]).astype(np.float32) @ np.column_stack([rows, -other / 2]).astype(np.float32).T
    may = product >= np.nextafter(least, np.float32(-np.inf))[:, None]
    return np.nonzero(may) if np.count_nonzero(may) <= FEW * may.size else None


def _nearer(asked: np.ndarray, rows: np.ndarray, names: np.ndarray, best: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, names) of the k nearest of each query among those found so far and rows in the order of their names."""
    pairs = _may_be_nearer(asked, rows, best[0][:, -1]) if best is not None and best[0].shape[1] == k else None
    if pairs is None:
        new = _first(np.round(_squared(asked, rows), 6), names, k)
        if best is None:
            return new
        dist, name = (np.concatenate(x, 1) for x in zip(best, new, strict=True))
        by_name = np.argsort(np.unique(name, return_inverse=True)[1].reshape(name.shape), axis=1, kind="stable")
        return _first(np.take_along_axis(dist, by_name, 1), np.take_along_axis(name, by_name, 1), k)
    query, row = pairs
    dist = np.round(((asked[query] - rows[row]) ** 2).sum(1), 6)
    near = dist <= best[0][query, -1]
    if not near.any():
        return best
    query, row, dist = query[near], row[near], dist[near]
    changed = np.unique(query)
    query = np.concatenate([np.repeat(changed, k), query])
    dist, name = np.concatenate([best[0][changed].ravel(), dist]), np.concatenate([best[1][changed].ravel(), names[row]])
    order = np.lexsort((np.unique(name, return_inverse=True)[1], dist, query))
    starts = np.searchsorted(query[order], changed)
    kept = order[(starts[:, None] + np.arange(k)).ravel()]
    out = best[0].copy(), best[1].copy()
    out[0][changed], out[1][changed] = dist[kept].reshape(-1, k), name[kept].reshape(-1, k)
    return out


class _Best:
    """The k nearest rows found so far of some queries, by distance, then number; places that are not filled yet have the bound and a number beyond all."""

    NONE = 1 << 62

    def __init__(self, asked: np.ndarray, k: int, edge: np.ndarray):
        self.asked, self.k = asked, k
        self.dist, self.name = np.repeat(edge[:, None], k, 1), np.full((len(asked), k), self.NONE)
        self.own = (asked**2).sum(1)
        self.length = np.sqrt(self.own)
        with np.errstate(over="ignore"):
            self.single = np.column_stack([asked, np.ones(len(asked))]).astype(np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    @property
    def edge(self) -> np.ndarray:
        """The squared distance that no neighbour exceeds."""
        return self.dist[:, -1]

    def least(self, most: float) -> np.ndarray:
        """What a product in single precision with a row of length ``most`` or less, less half the row's square, is at least if the row is within the edge."""
        off = (self.asked.shape[1] + 4) * 2.0**-23 * (self.length * most + most**2) + SLACK
        return np.nextafter(((self.own - self.edge) / 2 - off).astype(np.float32), np.float32(-np.inf))

    def add(self, query: np.ndarray, dist: np.ndarray, name: np.ndarray) -> None:
        self.held.append((query, dist, name))
        self.n_held += len(query)

    def settle(self) -> None:
        """What was added takes its places."""
        if not self.n_held:
            return
        query, dist, name = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n_held, k = [], 0, self.k
        changed = np.unique(query)
        query = np.concatenate([np.repeat(changed, k), query])
        dist, name = np.concatenate([self.dist[changed].ravel(), dist]), np.concatenate([self.name[changed].ravel(), name])
        order = np.lexsort((name, dist, query))
        kept = order[(np.searchsorted(query[order], changed)[:, None] + np.arange(k)).ravel()]
        self.dist[changed], self.name[changed] = dist[kept].reshape(-1, k), name[kept].reshape(-1, k)


def _axes(rows: np.ndarray) -> np.ndarray:
    """A few orthonormal directions in which rows vary most, about; any would do."""
    spread = rows - rows.mean(0)
    axes = np.eye(rows.shape[1])[:, np.argsort(-spread.var(0), kind="stable")[:AXES]]
    for _ in range(3):
        axes = np.linalg.qr(spread.T @ (spread @ axes) + 1e-9 * axes)[0]
    return axes


def _halved(rows: np.ndarray) -> list[np.ndarray]:
    """Places of rows in tiles of ``TILE_ROWS`` or less, each half of a larger one across the direction in which that varies most, about."""
    out, left = [], [np.arange(len(rows))]
    while left:
        at = left.pop()
        if len(at) <= TILE_ROWS:
            out.append(np.sort(at))
            continue
        spread = rows[at] - rows[at].mean(0)
        way = np.ones(rows.shape[1])
        for _ in range(3):
            way = spread.T @ (spread @ way)
            way /= max(np.abs(way).max(), 1e-300)
        order = np.argpartition(spread @ way, len(at) // 2)
        left += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


class _Tiles:
    """Rows in the order of their numbers, in tiles of rows that are near each other, and the box of each tile along a few directions.

    A query meets a tile only if the box can hold a row within the query's edge, first the tile that it is nearest to. Products in
    single precision, each off by less than the bound on their rounding, leave out most of the rest. Rows with missing or huge
    numbers are in tiles that all queries meet, and those are compared whole.
    """

    def __init__(self, rows: np.ndarray, names: np.ndarray):
        with np.errstate(over="ignore"):
            plain = np.abs(rows).max(1, initial=0) < 1e9 / max(1, rows.shape[1])  # False where a number is missing
        self.rows, self.names = rows, names
        odd = np.flatnonzero(~plain)
        self.odd = [odd[i : i + TILE_ROWS] for i in range(0, len(odd), TILE_ROWS)]
        at, self.places = np.flatnonzero(plain), []
        if not len(at):
            return
        self.places = [at[x] for x in _halved(rows[at])]
        self.axes = _axes(rows[at])
        self.center = np.stack([rows[x].mean(0) for x in self.places])
        boxes = [rows[x] @ self.axes for x in self.places]
        self.low, self.high = (np.stack([getattr(x, f)(0) for x in boxes]).astype(np.float32) for f in ("min", "max"))
        square = (rows**2).sum(1)
        self.single = [np.column_stack([rows[x], -square[x] / 2]).astype(np.float32).T.copy() for x in self.places]
        self.most = np.sqrt(square[at].max())

    def _bounds(self, found: _Best, margin: np.ndarray) -> np.ndarray:
        """Squared distances under which no row of a tile is, for each query and tile."""
        at = (found.asked @ self.axes).astype(np.float32)
        out = np.zeros((len(at), len(self.places)), np.float32)
        for i in range(0, len(at), 512):
            part, own, less = out[i : i + 512], at[i : i + 512], margin[i : i + 512, None].astype(np.float32)
            for j in range(at.shape[1]):
                x = own[:, j : j + 1]
                d = np.maximum(self.low[:, j] - x, x - self.high[:, j])
                d -= less
                np.maximum(d, 0, out=d)
                d *= d
                part += d
        out *= np.float32(1 - 1e-5)
        return out

    def _compare(self, found: _Best, query: np.ndarray, tile: int, least: np.ndarray) -> None:
        place, k = self.places[tile], found.k
        may = found.single[query] @ self.single[tile] >= least[query, None]
        pairs = np.flatnonzero(may)
        if not len(pairs):
            return
        if len(pairs) > max(FEW * may.size, k * len(query)):
            self._whole(found, query, place)
            return
        of, row = np.divmod(pairs, len(place))
        of, row = query[of], place[row]
        step = max(1, HELD_BYTES // (8 * self.rows.shape[1]))
        dist = np.concatenate([((found.asked[of[i : i + step]] - self.rows[row[i : i + step]]) ** 2).sum(1) for i in range(0, len(of), step)])
        dist, name = np.round(dist, 6), self.names[row]
        near = (dist < found.edge[of]) | (dist == found.edge[of]) & (name < found.name[of, -1])
        if near.any():
            found.add(of[near], dist[near], name[near])

    def _whole(self, found: _Best, query: np.ndarray, place: np.ndarray) -> None:
        found.settle()
        for i in range(0, len(query), 4096):
            part = query[i : i + 4096]
            found.dist[part], found.name[part] = _nearer(found.asked[part], self.rows[place], self.names[place], (found.dist[part], found.name[part]), found.k)

    def meet(self, found: _Best) -> None:
        """The queries' k nearest among those found before and these rows."""
        with np.errstate(invalid="ignore", over="ignore"):
            self._meet(found)

    def _meet(self, found: _Best) -> None:
        every = np.arange(len(found.asked))
        for place in self.odd:
            self._whole(found, every, place)
        if not self.places:
            return
        plain = found.length < 1e9
        if not plain.all():
            for place in self.places:
                self._whole(found, np.flatnonzero(~plain), place)
        bounds = self._bounds(found, MARGIN * (1 + found.length + self.most))
        first = _squared(found.asked, self.center).argmin(1)
        first[~plain | (bounds[every, first] > found.edge + SLACK)] = -1
        order = np.argsort(first, kind="stable")
        starts = np.searchsorted(first[order], np.arange(len(self.places) + 1))
        least = found.least(self.most)
        for t in np.flatnonzero(np.diff(starts)):
            self._compare(found, order[starts[t] : starts[t + 1]], t, least)
        found.settle()
        # a pair is met once: nothing compares with what is not a number
        bounds[~plain] = np.nan
        bounds[first >= 0, first[first >= 0]] = np.nan
        bounds = bounds.T.copy()
        edge, least = (found.edge + SLACK).astype(np.float32), found.least(self.most)
        for t in range(len(self.places)):
            query = np.flatnonzero(bounds[t] <= edge)
            if len(query):
                self._compare(found, query, t, least)
            if found.n_held > len(every):
                found.settle()
                edge, least = (found.edge + SLACK).astype(np.float32), found.least(self.most)
        found.settle()


def _copied(column: pa.Array) -> pa.Array:
    """The same, without the batch that it came in."""
    return column.take(pa.array(np.arange(len(column))))


def _best_of_task(d: int, k: int, query_kind: pa.DataType, kind: pa.DataType):
    """Over rows in the order of (task, side, id): a task's queries, then its corpus rows; the k nearest of every query, within its edge, leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, held, edges, found = None, [], [], [], None
        rows, names, n_rows = [], [], 0

        def compare() -> None:
            nonlocal found, rows
            if not rows or not held:
                return
            if found is None:
                every, edge = np.concatenate(held), np.concatenate(edges)
                found = [_Best(every[i : i + QUERY_PART], k, edge[i : i + QUERY_PART]) for i in range(0, len(every), QUERY_PART)]
            tiles = _Tiles(np.concatenate(rows), np.arange(n_rows - sum(map(len, rows)), n_rows))
            rows = []
            for part in found:
                tiles.meet(part)

        def told() -> Iterator[pa.RecordBatch]:
            compare()
            if found is None:
                return
            ids, corpus = pa.concat_arrays(asked), pa.concat_arrays(names)
            place, dist = np.concatenate([x.name for x in found]).ravel(), np.concatenate([x.dist for x in found]).ravel()
            kept = np.flatnonzero(place != _Best.NONE)
            for i in range(0, len(kept), 1 << 16):
                at = kept[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at // k)).cast(query_kind), corpus.take(pa.array(place[at])).cast(kind), pa.array(dist[at])], names=["query_id", "id", "distance"])

        for batch in batches:
            tasks, sides = batch.column("task").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(tasks)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if tasks[i] != now:
                    yield from told()
                    now, asked, held, edges, found = tasks[i], [], [], [], None
                    rows, names, n_rows = [], [], 0
                part = batch.slice(i, j - i)
                vectors = _matrix(part.column("vector"), d)
                if sides[i] == 0:
                    asked.append(_copied(part.column("query_id")))
                    held.append(vectors)
                    edges.append(part.column("edge").to_numpy(zero_copy_only=False))
                elif held:
                    rows.append(vectors)
                    names.append(_copied(part.column("id")))
                    n_rows += len(vectors)
                    if sum(x.nbytes for x in rows) >= HELD_BYTES:
                        compare()
        yield from told()

    return run


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, rank): the k rows of least squared L2 distance to each query, exactly; ties by id.

    ``queries`` and ``corpus`` have columns id and vector. On vectors of length 1 the order is that of
    the cosine. Rows without id or vector are no neighbours, queries without vector have none, and a vector with a
    missing number, or of another size than most, is infinitely far.

    The corpus is grouped around pivots, and a query goes only to the groups that can hold one of its
    neighbours, no further than those among a sample of the corpus. Within a group a grid of query blocks and ranges of rows is
    dealt to tasks by one shuffle: rows once for each block of queries, queries once for each range. So the plan is the same for
    any number of queries, no group has to fit a task, and only the pivots, the sample and counts of cells pass the driver. A task
    cuts its rows into tiles, and a query meets only those that can hold one of its neighbours.
    """
    schema = f"query_id {dict(queries.dtypes)['id']}, id {dict(corpus.dtypes)['id']}, distance double"
    kinds = to_arrow_type(queries.schema["id"].dataType), to_arrow_type(corpus.schema["id"].dataType)
    rows = corpus.select("id", "vector").where("id is not null and vector is not null")
    asked = queries.select("id", "vector").where("vector is not null")
    pivots = _pivots(rows)
    cells = durable(rows.mapInArrow(_in_cells(pivots), f"id {dict(corpus.dtypes)['id']}, vector {dict(corpus.dtypes)['vector']}, cell int, away double"), "nearest-cells")
    n = len(pivots) + 1
    counts, radius, least = np.zeros(n, np.int64), np.zeros(n - 1), np.zeros(n - 1)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("most"), F.min("away").alias("least")).collect():
        counts[r["cell"]] = r["n"]
        if r["cell"] < n - 1:
            radius[r["cell"]], least[r["cell"]] = r["most"], r["least"]
    sample = _sample(cells.where(F.col("cell") < n - 1), int(counts[:-1].sum()), pivots.shape[1])
    sent = durable(asked.mapInArrow(_cells_of_queries(pivots, counts, radius, least, sample, k), f"id {dict(queries.dtypes)['id']}, vector {dict(queries.dtypes)['vector']}, cell int, edge double"), "nearest-queries")
    wanted = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    numbers_of = [-(-wanted.get(c, 0) // QUERY_BLOCK) for c in range(n)], [max(1, -(-int(x) // RANGE_ROWS)) for x in counts]
    blocks, ranges = (F.array(*[F.lit(x) for x in m])[F.col("cell")] for m in numbers_of)
    task = ((F.col("cell").cast("long") * max(numbers_of[1]) + F.col("r")) * max(1, *numbers_of[0]) + F.col("b")).alias("task")
    every = lambda m: F.explode(F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")))
    grid = cells.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), ranges).cast("int").alias("r"), every(blocks).alias("b"))
    grid = grid.select(task, F.lit(1).alias("side"), F.lit(None).cast(dict(queries.dtypes)["id"]).alias("query_id"), "id", "vector", F.lit(None).cast("double").alias("edge"))
    # queries of equal id are told apart by their vector where they are dealt, and ranked together
    posed = sent.select("id", "vector", "cell", "edge", F.pmod(F.xxhash64("id", "vector"), blocks).cast("int").alias("b"), every(ranges).alias("r"))
    posed = posed.select(task, F.lit(0).alias("side"), F.col("id").alias("query_id"), F.lit(None).cast(dict(corpus.dtypes)["id"]).alias("id"), F.col("vector").cast(dict(corpus.dtypes)["vector"]).alias("vector"), "edge")
    pairs, tasks = sum(wanted.get(c, 0) * int(x) for c, x in enumerate(counts)), sum(b * r for b, r in zip(*numbers_of, strict=True))
    dealt = posed.unionByName(grid).repartition(max(1, min(tasks, -(-pairs // TASK_PAIRS))), "task").sortWithinPartitions("task", "side", "id")
    found = dealt.mapInArrow(_best_of_task(pivots.shape[1], k, *kinds), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def parents_of_hits(hits: DataFrame, children: DataFrame) -> DataFrame:
    """(query_id, parent_id, rank): the parents of hits in the order of their first hit."""
    named = hits.join(children.select(F.col("id"), "parent_id"), "id")
    first = named.groupBy("query_id", "parent_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "parent_id", F.row_number().over(W.partitionBy("query_id").orderBy("first", "parent_id")).alias("rank"))


def parent_documents(queries: DataFrame, children: DataFrame, k: int = 10) -> DataFrame:
    """At most k parents: those of the k nearest children (id, parent_id, vector)."""
    return parents_of_hits(nearest(queries, children, k), children)


def multi_vector(queries: DataFrame, chunks: DataFrame, questions: Column, embed: Callable[[Column], Column], k: int = 10) -> DataFrame:
    """Chunks found by the vectors of questions about them: (query_id, parent_id, rank)."""
    asked = chunks.select("chunk_id", F.posexplode(questions).alias("n", "question"))
    vectors = asked.select(F.concat_ws("-", "chunk_id", "n").alias("id"), F.col("chunk_id").alias("parent_id"), embed(F.col("question")).alias("vector"))
    return parent_documents(queries, vectors, k)


def look_up(ids: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Documents by id; ids without a document are dropped."""
    return ids.join(documents, key)


def limit_then_filter(docs: Column, limit: int | None, keep: Callable[[Column], Column]) -> Column:
    """The first ``limit`` documents of an array, and of these the ones that ``keep`` accepts: in this order."""
    return F.filter(F.slice(docs, 1, limit) if limit is not None else docs, keep)


def ranked_contexts(found: DataFrame, documents: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(query_id, documents): the found documents' texts in the order of rank, at most ``limit``."""
    within = found if limit is None else found.where(F.col("rank") <= limit)
    rows = within.join(documents.select(F.col(key).alias("parent_id"), "text"), "parent_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return rows.groupBy("query_id").agg(F.transform(ordered, lambda r: r["text"]).alias("documents"))
