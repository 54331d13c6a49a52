"""Exact nearest neighbours in a few dimensions.

References are made distinct first. A set that fits `BROADCAST_BYTES` is broadcast. Larger ones are
cut into cells: a k-d split of a bounded sample, repeated inside every cell that still holds more
than `cell_rows`. What the search needs of a cell is its bounding box. A query first visits the
cell that the split itself sends it to. Then it visits cells in rounds, nearest box first: a round
asks for the next few boxes that are nearer than the best found so far, and the bound shrinks
before the next one, so a query never lists the cells it might need.
Each (cell, slice of its visitors) is one task; inside it the references form leaves with bounding
boxes of their own, visited in the same order. Results are exact on every path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.functions.small import dropped, shuffle_width, stored

BROADCAST_BYTES = 32 << 20
CELL_ROWS = 65_536
#: Cells that one split makes; cells in all: beyond, cells grow with the references.
FAN, MOST_CELLS = 1_024, 1 << 20
SAMPLE_PER_CELL = 16
QUERIES_PER_TASK = 20_000
#: Boxes asked for in the first round after a query's own cell, and how many times more in each later one.
ASKED, MORE = 8, 8
#: References of a leaf, leaves of a group, queries handled together.
LEAF, GROUP, CHUNK = 48, 16, 2_048
#: Boxes looked at in order of distance before all that remain are listed.
FIRST = 8
#: Distance between neighbouring groups on the axis that keeps them apart.
APART = 1e100


# ---- Inside a task -------------------------------------------------------------------------
def _widest_axis(points: np.ndarray) -> int:
    """Axis of the largest interquartile range, so that a few outliers do not make every
    cut fall on an axis where the mass of the points is narrow."""
    some = np.sort(points[:: max(1, len(points) // 256)], axis=0)
    middle = some[(3 * len(some)) // 4] - some[len(some) // 4]
    if middle.any():
        return int(middle.argmax())
    return int((points.max(axis=0) - points.min(axis=0)).argmax())


def _leaf_order(points: np.ndarray, size: int) -> np.ndarray:
    """Row order in which each run of `size` rows is a leaf of a k-d tree."""
    order, stack = np.arange(len(points)), [(0, len(points))]
    while stack:
        start, stop = stack.pop()
        if stop - start <= size:
            continue
        part = points[order[start:stop]]
        half = -(-(stop - start) // size) // 2 * size
        order[start:stop] = order[start:stop][np.argpartition(part[:, _widest_axis(part)], half)]
        stack += [(start, start + half), (start + half, stop)]
    return order


def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to boxes: the same ones, or its own row of them."""
    total = np.zeros((len(points), low.shape[-2]))
    for j in range(points.shape[1]):
        x = points[:, j][:, None]
        gap = np.maximum(np.maximum(low[..., j] - x, x - high[..., j]), 0.0)
        total += gap * gap
    return total


def _in_order(gaps: np.ndarray, reach: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, boxes): step by step each row's next nearest box, while it is within the row's reach."""
    rows, boxes = gaps.shape
    first = min(FIRST, boxes)
    near = np.argpartition(gaps, first - 1, axis=1)[:, :first] if first < boxes else np.tile(np.arange(boxes), (rows, 1))
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(gaps, near, 1), axis=1, kind="stable"), 1)
    for step in range(first):
        at = np.take_along_axis(gaps, near[:, step : step + 1], 1)[:, 0]
        some = np.flatnonzero(at <= reach())
        if not len(some):
            return
        yield some, near[some, step]
    if first == boxes:
        return
    left = gaps <= reach()[:, None]
    np.put_along_axis(left, near, False, 1)
    row, box = np.nonzero(left)
    order = np.lexsort((gaps[row, box], row))
    row, box = row[order], box[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    for step in range(place.max(initial=-1) + 1):
        at = np.flatnonzero(place == step)
        at = at[gaps[row[at], box[at]] <= reach()[row[at]]]
        if len(at):
            yield row[at], box[at]


class Block:
    """References of a task as leaves and groups of leaves with their bounding boxes."""

    def __init__(self, refs: np.ndarray):
        size = LEAF * GROUP
        count, width = refs.shape
        groups = max(1, -(-count // size))
        self.rows = np.full(groups * size, -1)
        order = _leaf_order(refs, size)
        for g in range(groups):
            part = order[g * size : (g + 1) * size]
            self.rows[g * size : g * size + len(part)] = part[_leaf_order(refs[part], LEAF)]
        filled = self.rows >= 0
        points = np.full((groups * size, width), np.inf)
        points[filled] = refs[self.rows[filled]]
        self.leaves = points.reshape(-1, LEAF, width)
        tops = np.where(np.isinf(self.leaves), -np.inf, self.leaves)
        self.low = self.leaves.min(axis=1).reshape(groups, GROUP, width)
        self.high = tops.max(axis=1).reshape(groups, GROUP, width)

    def visits(self, points: np.ndarray, reach: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, leaves, squared distances to the references of the leaves), nearest boxes first."""
        gaps = _gaps(points, self.low.min(axis=1)[None], self.high.max(axis=1)[None])
        for rows, groups in _in_order(gaps, reach):
            inside = _gaps(points[rows], self.low[groups], self.high[groups])
            order = np.argsort(inside, axis=1)
            for step in range(GROUP):
                leaf = order[:, step]
                some = np.flatnonzero(inside[np.arange(len(rows)), leaf] <= reach()[rows])
                if not len(some):
                    break
                leaves = groups[some] * GROUP + leaf[some]
                held = self.leaves[leaves]
                total = np.zeros(held.shape[:2])
                for j in range(points.shape[1]):
                    diff = held[:, :, j] - points[rows[some], j][:, None]
                    total += diff * diff
                yield rows[some], leaves, total

    def nearest(self, queries: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
        """Smallest squared distance of each query to the references, at most its `bound` (squared)."""
        best = np.full(len(queries), np.inf) if bound is None else np.array(bound, dtype=float)
        for start in range(0, len(queries), CHUNK):
            now = best[start : start + CHUNK]
            # What is exactly as far as the best can't improve it.
            for rows, _, found in self.visits(queries[start : start + CHUNK], lambda now=now: np.nextafter(now, -1.0)):
                now[rows] = np.minimum(now[rows], found.min(axis=1))
        return best

    def nearest_rows(self, queries: np.ndarray, ids: np.ndarray, dist: np.ndarray, found: np.ndarray):
        """(squared distances, ids) of the k nearest rows per query, nearest first, ties by id.

        `dist` and `found` (queries x k) carry in the result of blocks searched before.
        """
        carried = np.asarray(found, dtype=object).ravel()
        names, places = places_of(np.concatenate([ids, carried]))
        places[len(ids) :][carried == ""] = -1
        dist, now = self.nearest_places(queries, places[: len(ids)], dist, places[len(ids) :].reshape(dist.shape))
        return dist, named(now, names)

    def nearest_places(self, queries: np.ndarray, places: np.ndarray, dist: np.ndarray, found: np.ndarray):
        """`nearest_rows` by the references' places in the order of their ids; -1 where there is none.

        Texts are not compared here: ties are settled by place.
        """
        dist, found = np.array(dist, dtype=float), np.array(found)
        k = dist.shape[1]
        for start in range(0, len(queries), CHUNK):
            some = slice(start, start + CHUNK)
            d, n = dist[some], found[some]
            # At equal distance a smaller id may still come in.
            for rows, leaves, total in self.visits(queries[some], lambda d=d: d[:, -1]):
                better = np.flatnonzero(total.min(axis=1) <= d[rows, -1])
                rows, total = rows[better], total[better]
                held = self.rows.reshape(-1, LEAF)[leaves[better]]
                all_d = np.concatenate([d[rows], total], axis=1)
                all_n = np.concatenate([n[rows], np.where(held >= 0, places[held], -1)], axis=1)
                d[rows], n[rows] = _first(all_d, all_n, k)
        return dist, found


def _first(dist: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row by distance, then place; in that order."""
    within = dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
    out_d, out_n = np.empty((len(dist), k)), np.empty((len(dist), k), dtype=places.dtype)
    tied = within.sum(axis=1) > k
    for rows, width in ((~tied, k), (tied, dist.shape[1])):
        keep = within[rows] if width == k else np.ones((rows.sum(), width), dtype=bool)
        d, n = (part[rows][keep].reshape(-1, width) for part in (dist, places))
        order = np.lexsort((n, d), axis=1)[:, :k]
        out_d[rows], out_n[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
    return out_d, out_n


def places_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order, place of each id among them)."""
    _, first, places = np.unique(ids.astype(str), return_index=True, return_inverse=True)
    return ids[first], places


def named(places: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The names at the places, empty at -1."""
    out = np.full(places.shape, "", dtype=object)
    out[places >= 0] = names[places[places >= 0]]
    return out


def _split(points: np.ndarray, cells: int) -> tuple[list, list, list, list]:
    """A k-d tree with at most `cells` leaves: axis (-1 in a leaf), cut, left (or the leaf's number), right."""
    axis, cut, left, right = [], [], [], []
    leaves = 0

    def grow(part: np.ndarray, budget: int) -> int:
        nonlocal leaves
        node = len(axis)
        axis.append(-1), cut.append(0.0), left.append(-1), right.append(-1)
        spread = part.max(axis=0) - part.min(axis=0)
        a = _widest_axis(part)
        c = float(np.median(part[:, a]))
        below = part[:, a] < c
        if spread.any() and not below.any():
            # The median is the smallest value: cut above it, on an axis with spread.
            a = int(spread.argmax())
            c = float(part[:, a].min() / 2 + part[:, a].max() / 2)
            below = part[:, a] < c
        if budget <= 1 or not spread.any() or not below.any():
            left[node], leaves = leaves, leaves + 1
            return node
        axis[node], cut[node] = a, c
        left[node] = grow(part[below], budget // 2)
        right[node] = grow(part[~below], budget - budget // 2)
        return node

    grow(points, cells)
    return axis, cut, left, right


def _located(points: np.ndarray, tree) -> np.ndarray:
    """Number of the leaf that each point falls in."""
    axis, cut, left, right = map(np.asarray, tree)
    node = np.zeros(len(points), dtype=np.int64)
    while True:
        inner = np.flatnonzero(axis[node] >= 0)
        if not len(inner):
            return left[node]
        at = node[inner]
        below = points[inner, axis[at]] < cut[at]
        node[inner] = np.where(below, left[at], right[at])


def _cell_of(points: np.ndarray, passes: list[dict]) -> np.ndarray:
    """The cell that the trees of all passes send each point to."""
    cell = np.zeros(len(points), dtype=np.int64)
    for trees in passes:
        inner = np.zeros(len(points), dtype=np.int64)
        order = np.argsort(cell, kind="stable")
        for here in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
            if cell[here[0]] in trees:
                inner[here] = _located(points[here], trees[cell[here[0]]])
        # Numbers keep the order of the cells they come from.
        cell = cell * FAN + inner
    return cell


class Boxes:
    """Bounding boxes of cells, in runs of about as many boxes as there are runs, cells being in k-d order."""

    LEAST_RUN = 16

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray, passes: list[dict]):
        self.cells, self.low, self.high, self.passes = cells, low, high, passes
        self.run = max(self.LEAST_RUN, math.isqrt(len(cells)))
        starts = np.arange(0, len(cells), self.run)
        self.run_low = np.minimum.reduceat(low, starts, axis=0)
        self.run_high = np.maximum.reduceat(high, starts, axis=0)

    def own(self, points: np.ndarray) -> np.ndarray:
        """The box of the cell that the split sends each point to: any box will do for a first bound."""
        at = np.searchsorted(self.cells, _cell_of(points, self.passes))
        return np.minimum(at, len(self.cells) - 1)

    def next(self, points, reach, last_gap, last_box, own, count: int):
        """(rows, boxes, gaps): of each point the next `count` boxes after (last_gap, last_box), without
        its `own`, whose gap is within reach."""
        out = []
        chunk = max(16, min(CHUNK, 1_000_000 // len(self.run_low)))
        for start in range(0, len(points), chunk):
            some = slice(start, start + chunk)
            x = points[some]
            limit = reach[some]
            row, run = np.nonzero(_gaps(x, self.run_low[None], self.run_high[None]) <= limit[:, None])
            boxes = run[:, None] * self.run + np.arange(self.run)
            rows = np.repeat(row, self.run)
            boxes = boxes.ravel()
            inside = boxes < len(self.cells)
            rows, boxes = rows[inside], boxes[inside]
            gap = np.zeros(len(rows))
            for j in range(x.shape[1]):
                d = np.maximum(np.maximum(self.low[boxes, j] - x[rows, j], x[rows, j] - self.high[boxes, j]), 0.0)
                gap += d * d
            lg, lb = last_gap[some][rows], last_box[some][rows]
            good = (gap <= limit[rows]) & ((gap > lg) | ((gap == lg) & (boxes > lb))) & (boxes != own[some][rows])
            rows, boxes, gap = rows[good], boxes[good], gap[good]
            order = np.lexsort((boxes, gap, rows))
            rows, boxes, gap = rows[order], boxes[order], gap[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < count
            out.append((rows[kept] + start, boxes[kept], gap[kept]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _matrix(frame: pd.DataFrame, columns) -> np.ndarray:
    return frame[columns].to_numpy(dtype=float)


# ---- Over tables ---------------------------------------------------------------------------
def _cells(points: DataFrame, columns, cell_rows: int) -> DataFrame:
    return _cells_and_trees(points, columns, cell_rows)[0]


def _cells_and_trees(points: DataFrame, columns, cell_rows: int) -> tuple[DataFrame, list[dict]]:
    """`points` with `_cell`, split until no cell holds more than `cell_rows`, and the trees of each pass.

    The trees of one pass are read to the driver: the first pass has one, the second at most `FAN`.
    """
    total = points.count()
    cell_rows = max(cell_rows, -(-total // MOST_CELLS))
    now = points.withColumn("_cell", F.lit(0).cast("long"))
    fields = ", ".join(f"`{n}` {t}" for n, t in now.dtypes)
    spot = F.pmod(F.xxhash64(*columns), F.lit(1 << 20))
    passes: list[dict] = []
    while True:
        large = now.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > cell_rows)
        # Cells of a sample are uneven: aim at half their bound.
        parts = F.least(F.lit(FAN), F.ceil(2 * F.col("_n") / cell_rows)).cast("int")
        share = F.ceil(F.lit(1.3 * SAMPLE_PER_CELL * (1 << 20)) * parts / F.col("_n"))
        large = stored(large.select(F.col("_cell").alias("_of"), parts.alias("_parts"), share.alias("_share")))
        if large.isEmpty():
            return now, passes
        sample = now.join(large, F.col("_cell") == F.col("_of")).where(spot < F.col("_share"))

        def grow(cell: pd.DataFrame) -> pd.DataFrame:
            tree = _split(_matrix(cell, columns), int(cell["_parts"].iloc[0]))
            return pd.DataFrame({"cell": [cell["_of"].iloc[0]], **dict(zip("acds", [[t] for t in tree], strict=True))})

        grown = sample.select("_of", "_parts", *columns).groupBy("_of").applyInPandas(
            grow, "cell long, a array<int>, c array<double>, d array<int>, s array<int>"
        )
        trees = {r["cell"]: (r["a"], r["c"], r["d"], r["s"]) for r in grown.collect()}
        if not any(len(t[0]) > 1 for t in trees.values()):
            return now, passes
        passes.append(trees)
        shared = points.sparkSession.sparkContext.broadcast(trees)

        def place(batches):
            for batch in batches:
                at, cell = _matrix(batch, columns), batch["_cell"].to_numpy()
                # Numbers keep the order of the cells they come from.
                inner = np.zeros(len(batch), dtype=np.int64)
                for c in np.unique(cell):
                    if c in shared.value:
                        here = np.flatnonzero(cell == c)
                        inner[here] = _located(at[here], shared.value[c])
                batch["_cell"] = cell * FAN + inner
                yield batch

        before, now = now, stored(now.mapInPandas(place, fields))
        if len(passes) > 1:  # the first reads the caller's table
            dropped([before])


def _rounds(
    asked: DataFrame, refs: DataFrame, columns, carried: dict[str, str], reach, search, merge, cell_rows: int
) -> DataFrame:
    """Every visit of every query: _key and the carried columns, to be merged per key.

    asked: _key, columns and the carried ones. reach(batch): squared distance within which a box
    may still matter. search(queries, references): the carried columns after a visit.
    merge: aggregates by which several visits of a key become one.
    """
    placed, passes = _cells_and_trees(refs, columns, cell_rows)
    edges = [f(c).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i, c in enumerate(columns)]
    boxes = placed.groupBy("_cell").agg(*edges).orderBy("_cell").toPandas()
    low, high = (boxes[[f"{n}{i}" for i in range(len(columns))]].to_numpy(dtype=float) for n in "lh")
    if not len(boxes):
        return asked.select("_key", *carried).limit(0)
    shared = asked.sparkSession.sparkContext.broadcast(Boxes(boxes["_cell"].to_numpy(), low, high, passes))
    kinds = dict(asked.dtypes)
    state = {"_key": kinds["_key"], **{c: "double" for c in columns}, **carried, "_gap": "double", "_box": "long", "_own": "long"}
    schema = ", ".join(f"`{n}` {t}" for n, t in state.items()) + ", _cell long"

    def first(batches):
        for batch in batches:
            at = shared.value.own(_matrix(batch, columns))
            yield batch.assign(_gap=-1.0, _box=-1, _own=at, _cell=shared.value.cells[at])

    def ask(batch: pd.DataFrame, count: int) -> pd.DataFrame:
        rows, at, gaps = shared.value.next(
            _matrix(batch, columns), reach(batch), *(batch[c].to_numpy() for c in ("_gap", "_box", "_own")), count
        )
        more = batch.iloc[rows].copy()
        more["_gap"], more["_box"], more["_cell"] = gaps, at, shared.value.cells[at]
        return more

    def search_and_ask(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """Results, without a cell, and the first visits that they leave to be made."""
        found = search(queries, block)
        return pd.concat([found.assign(_cell=-1), ask(found, ASKED)])

    # What a round leaves is a key and the carried columns; wider rows go once the next round has read them.
    start = stored(asked.select("_key", *columns, *carried).mapInPandas(first, schema))
    visits = stored(_visit(start, placed, columns, [*state, "_cell"], schema, search_and_ask))
    dropped([start])
    seen = [stored(visits.where("_cell < 0").select("_key", *carried))]
    wanted, spent, count = visits.where("_cell >= 0"), visits, ASKED
    while not wanted.isEmpty():
        visits = stored(_visit(wanted, placed, columns, [*state, "_cell"], schema, search))
        dropped([spent])
        last = F.max(F.struct("_gap", "_box"))
        same = [F.first(c).alias(c) for c in (*columns, "_own")]
        # Who was given all boxes asked for may need more; who got fewer has seen all.
        merged = visits.groupBy("_key").agg(*same, *merge, last.alias("_last"), F.count("*").alias("_boxes")).where(F.col("_boxes") >= count)
        now = merged.withColumns({"_gap": F.col("_last._gap"), "_box": F.col("_last._box")}).select(*state)
        count *= MORE
        # The look at the boxes is heavier than its rows: a stated number of tasks.
        now = now.repartition(4 * _tasks(now), "_key")
        wanted = spent = stored(now.mapInPandas(lambda batches, count=count: (ask(b, count) for b in batches), schema))
        seen.append(stored(visits.select("_key", *carried)))
        dropped([visits])
    dropped([spent])
    return reduce(DataFrame.unionByName, seen)


def _visit(wanted: DataFrame, refs: DataFrame, columns, state, schema: str, search) -> DataFrame:
    """The queries of `wanted` after they have seen the references of their `_cell`.

    A cell with many visitors is split into slices; its references go to every slice.
    """
    slices = F.ceil(F.count(F.lit(1)) / F.lit(QUERIES_PER_TASK)).cast("int").alias("_slices")
    load = wanted.groupBy("_cell").agg(slices)
    slice_of = F.pmod(F.xxhash64("_key"), F.col("_slices")).cast("int")
    left = wanted.join(load, "_cell").withColumn("_slice", slice_of).drop("_slices")
    every = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    right = refs.join(load, "_cell").withColumn("_slice", every).drop("_slices")

    def scan(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame(columns=list(state))
        return search(queries, block)[list(state)]

    # A stated number of tasks: by bytes alone, few tasks would get this narrow but heavy work.
    tasks, at = 4 * _tasks(refs), ["_cell", "_slice"]
    left, right = left.repartition(tasks, *at), right.repartition(tasks, *at)
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(scan, schema)


def _tasks(df: DataFrame) -> int:
    return max(shuffle_width(df), df.sparkSession.sparkContext.defaultParallelism)


def _spread_out(queries: DataFrame, key: str, columns) -> DataFrame:
    """The search is far heavier than a narrow shuffle: the queries go to all tasks."""
    return queries.select(F.col(key).alias("_key"), *columns).repartition(_tasks(queries), "_key")


def nearest_distance(
    queries: DataFrame,
    references: DataFrame,
    columns,
    key: str = S.ROW_ID,
    out: str = "distance",
    group: str | None = None,
    broadcast_rows: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(key, out): Euclidean distance of each query to its nearest reference row.

    `columns` are non-null doubles on both sides. `group`: an integer column of both sides; only
    references of the query's group count. NULL if there is no such reference row.
    """
    columns = list(columns)
    if group is not None:
        # One search for all groups: they lie apart on an axis of their own.
        queries, references = (d.withColumn("_group", F.col(group).cast("double") * F.lit(APART)) for d in (queries, references))
        columns = [*columns, "_group"]
    points = stored(references.select(*columns).distinct())
    if broadcast_rows is None:
        broadcast_rows = BROADCAST_BYTES // (8 * len(columns))
    if points.count() <= broadcast_rows:
        found = _by_broadcast(_spread_out(queries, key, columns), points, columns)
    else:
        asked = queries.select(F.col(key).alias("_key"), *columns)
        found = visited(asked, points, columns, cell_rows).select("_key", "_best")
    near = F.when(F.col("_best") < APART, F.sqrt("_best"))
    return found.select(F.col("_key").alias(key), near.alias(out))


def _by_broadcast(asked: DataFrame, points: DataFrame, columns) -> DataFrame:
    held = _matrix(points.toPandas(), columns)
    shared = asked.sparkSession.sparkContext.broadcast(Block(held) if len(held) else None)

    def scan(batches):
        for batch in batches:
            block = shared.value
            found = block.nearest(_matrix(batch, columns)) if block else np.full(len(batch), np.inf)
            yield pd.DataFrame({"_key": batch["_key"], "_best": found})

    return asked.mapInPandas(scan, f"_key {dict(asked.dtypes)['_key']}, _best double")


def visited(asked: DataFrame, points: DataFrame, columns, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(_key, _best, _visits): squared distance to the nearest point, and the cells it took."""

    def search(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = Block(_matrix(block, columns)).nearest(_matrix(rows, columns), rows["_best"].to_numpy(dtype=float))
        return rows.assign(_best=found)

    def reach(batch: pd.DataFrame) -> np.ndarray:
        return np.nextafter(batch["_best"].to_numpy(dtype=float), -1.0)

    best = F.min("_best").alias("_best")
    start = asked.withColumn("_best", F.lit(float("inf")))
    seen = _rounds(start, points, columns, {"_best": "double"}, reach, search, [best], cell_rows)
    return seen.groupBy("_key").agg(best, F.count("*").alias("_visits"))


# ---- k nearest rows ---------------------------------------------------------------------
def _few_copies(references: DataFrame, columns, k: int, rows_each: int = 100_000) -> DataFrame:
    """At most k rows per identical vector, the smallest ids: no other copy can be among the
    k nearest. Two rounds, so that a vector held by many rows is thinned in parallel."""
    salts = max(1, -(-references.count() // rows_each))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts))
    first = Window.partitionBy(*columns, "_salt").orderBy("_id")
    second = Window.partitionBy(*columns).orderBy("_id")
    return (
        references.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= k)
        .withColumn("_r", F.row_number().over(second))
        .where(F.col("_r") <= k)
        .drop("_salt", "_r")
    )


def nearest_rows(
    queries: DataFrame,
    references: DataFrame,
    columns,
    k: int,
    key: str = S.ROW_ID,
    broadcast_rows: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(key, neighbours): the keys of the k nearest reference rows, nearest first, ties by key.

    Keys are strings. Exact on both paths, as for `nearest_distance`.
    """
    columns = list(columns)
    points = stored(_few_copies(references.select(F.col(key).alias("_id"), *columns), columns, k))
    asked = _spread_out(queries, key, columns)
    carried = {"_d": "array<double>", "_n": "array<string>"}

    def search(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids = block["_id"].to_numpy(dtype=object)
        dist, found = Block(_matrix(block, columns)).nearest_rows(_matrix(rows, columns), ids, np.stack(rows["_d"]), np.stack(rows["_n"]))
        return rows.assign(_d=list(dist), _n=[list(row) for row in found])

    start = asked.withColumns({"_d": F.array_repeat(F.lit(float("inf")), k), "_n": F.array_repeat(F.lit(""), k)})
    size = points.agg(F.count("*").alias("n"), F.sum(F.octet_length("_id")).alias("ids")).first()
    if broadcast_rows is None:
        small = (size["ids"] or 0) + size["n"] * 8 * len(columns) <= BROADCAST_BYTES
    else:
        small = size["n"] <= broadcast_rows
    if small:
        held = points.toPandas()
        block = Block(_matrix(held, columns)) if len(held) else None
        shared = queries.sparkSession.sparkContext.broadcast((block, *places_of(held["_id"].to_numpy(dtype=object))))

        def scan(batches):
            block, names, places = shared.value
            for batch in batches:
                if block:
                    none = np.full((len(batch), k), -1, dtype=places.dtype)
                    dist, found = block.nearest_places(_matrix(batch, columns), places, np.full(none.shape, np.inf), none)
                    batch = batch.assign(_d=list(dist), _n=[list(row) for row in named(found, names)])
                yield batch[["_key", "_d", "_n"]]

        best = start.mapInPandas(scan, "_key string, _d array<double>, _n array<string>")
    else:

        def reach(batch: pd.DataFrame) -> np.ndarray:
            return np.stack(batch["_d"])[:, -1]

        # A visit returns the carried rows too; the same neighbour then counts once.
        pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("_d", "_n"))))
        top = F.slice(F.array_sort(F.filter(pairs, lambda p: p["_n"] != "")), 1, k)
        padding = F.array_repeat(F.struct(F.lit(float("inf")).alias("_d"), F.lit("").alias("_n")), k)
        full = F.slice(F.concat(top, padding), 1, k)
        merge = [F.transform(full, lambda p: p["_d"]).alias("_d"), F.transform(full, lambda p: p["_n"]).alias("_n")]
        best = _rounds(start, points, columns, carried, reach, search, merge, cell_rows).groupBy("_key").agg(*merge)
    return best.select(F.col("_key").alias(key), F.filter("_n", lambda name: name != "").alias("neighbours"))
