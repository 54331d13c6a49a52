"""Exact top-k by inner product, with sorted lists that are only read in order.

Each component of the vectors of a sub-block makes one list, sorted by value. A query reads its
lists from the top where its own component is positive and from the bottom where it is negative,
deeper where its component is larger. What it has read of a vector gives that vector's lower and
upper bound: a component not yet read is worth at least the end of its list and at most the value
the reading has come to. Reading stops when few vectors are left whose upper bound reaches the
k-th lower bound, ties included; nothing outside can qualify, and the scores of those few are
resolved exactly. The k-th score resolved so far is a lower bound for the next sub-block, and the
depth that one query needed is where it starts there.

Vectors are dealt to blocks and queries to chunks, and every chunk meets every block: the queries
are a stated share of the rows. Each meeting returns k rows per query, and the best k over the
blocks win; ties go to the smaller id.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no
part; vectors of another length than the query's are no candidates; a repeated row is a candidate as
often as it occurs, and as a query it is answered as often; two vectors under one id are two
queries; all rows with the query's id count as its own; rows without an id take no part. Scores
are exact; one beyond a long counts as the nearest long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.small import stored

#: Vectors of a block, which one task holds, and of a sub-block, which has lists of its own.
BLOCK_VECTORS, LIST_VECTORS = 32_768, 4_096
CHUNK_QUERIES = 4_096
#: Share of each list read at first, without and with a bar from other lists; growth of the depth;
#: and the share of vectors left at which reading stops.
ALONE, HELPED, GROWTH, LEFT = 0.75, 0.45, 1.15, 1 / 4
#: Components up to here multiply and add exactly in floats and 64-bit integers.
EXACT = 1 << 20
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "query_no long, copies long, query_id long, vec_id long, score long"


def quantised(vectors: pd.Series) -> np.ndarray:
    """floor(256 x) of every component; whole numbers, as floats if they are exact."""
    values = np.floor(256.0 * np.stack(vectors.to_numpy()).astype(np.float64))
    if not values.size or np.abs(values).max() <= EXACT:
        return values
    return np.array([[int(v) for v in row] for row in values], dtype=object)


class SortedLists:
    """One list per component over the vectors of a sub-block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.exact = values.dtype != object
        if self.exact:
            rows = np.argsort(values, axis=0, kind="stable")
            self.sorted = np.ascontiguousarray(np.take_along_axis(values, rows, axis=0).T)
            self.rows = np.ascontiguousarray(rows.T)

    def _resolved(self, query: np.ndarray, rows: np.ndarray, found: list[tuple[int, int]], k: int):
        """`found` and the exact scores of some rows: the best k, ties to the smaller id."""
        if self.exact and query.dtype != object:
            scores = self.values[rows] @ query
        else:
            whole = [int(x) for x in query]
            scores = (sum(int(v) * x for v, x in zip(row, whole, strict=True)) for row in self.values[rows])
        scores = [max(LEAST, min(MOST, int(s))) for s in scores]
        both = [*found, *zip(self.ids[rows].tolist(), scores, strict=True)]
        return sorted(both, key=lambda x: (-x[1], x[0]))[:k]

    def best(
        self, query: np.ndarray, own: int, k: int, found: list[tuple[int, int]], share: float = ALONE
    ) -> tuple[list[tuple[int, int]], float]:
        """The best k (id, score) of `found` and of this sub-block, and the share of the lists it took.

        found: resolved in other sub-blocks, best first.
        """
        others = self.ids != own
        lists = np.flatnonzero(query) if self.exact and query.dtype != object else []
        if not len(lists) or others.sum() <= k:
            return self._resolved(query, np.flatnonzero(others), found, k), share
        weight, count = query[lists], len(self.ids)
        down = weight > 0
        size = np.abs(weight) / np.abs(weight).mean()
        least = np.where(down, self.sorted[lists, 0], self.sorted[lists, -1]) * weight
        while True:
            depth = np.clip((share * count * size).astype(int), 1, count)
            reached = np.where(down, self.sorted[lists, count - depth], self.sorted[lists, depth - 1]) * weight
            rows, above = [], []
            plan = zip(lists.tolist(), depth.tolist(), down.tolist(), weight.tolist(), reached.tolist(), strict=True)
            for at, upto, top, w, end in plan:
                read = slice(count - upto, None) if top else slice(upto)
                rows.append(self.rows[at, read])
                above.append(self.sorted[at, read] * w - end)
            rows, above = np.concatenate(rows), np.concatenate(above)
            # What is read counts in full, the rest as the value reached or as the least one.
            # Sums of whole numbers below 2**53: exact.
            upper = reached.sum() + np.bincount(rows, above, count)
            if len(found) == k:
                bar = found[-1][1]
            else:
                lower = least.sum() + np.bincount(rows, above + np.repeat(reached - least, depth), count)
                bar = np.partition(lower[others], -k)[-k]
            open_rows = np.flatnonzero((upper >= bar) & others)
            if len(open_rows) <= max(k, LEFT * count) or (depth == count).all():
                return self._resolved(query, open_rows, found, k), share
            share *= GROWTH


def _meeting(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        if len(queries) and len(block):
            ids, values = block["vec_id"].to_numpy(), quantised(block["vector"])
            cuts = range(0, len(ids), LIST_VECTORS)
            lists = [SortedLists(ids[a : a + LIST_VECTORS], values[a : a + LIST_VECTORS]) for a in cuts]
            names = zip(queries["query_no"].tolist(), queries["copies"].tolist(), queries["vec_id"].tolist(), strict=True)
            for (query_no, copies, query_id), query in zip(names, quantised(queries["vector"]), strict=True):
                found, share = [], ALONE
                for i, part in enumerate(lists):
                    # A little less than sufficed before; the first bar saves the most.
                    share = min(share / GROWTH, HELPED if i == 1 else 1.0) if i else ALONE
                    found, share = part.best(query, query_id, k, found, share)
                out += [(query_no, copies, query_id, vec_id, score) for vec_id, score in found]
        return pd.DataFrame(out, columns=["query_no", "copies", "query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query row."""
    vectors = rows.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    vectors = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    # Arrays of doubles as keys: -0.0 and 0.0 are one value.
    groups = vectors.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"), F.count("*").alias("copies"))
    vectors = stored(groups.withColumn("query_no", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(vectors.count() / BLOCK_VECTORS))
    chunks = max(1, math.ceil(vectors.where("asks").count() / CHUNK_QUERIES))

    def numbers(least: int, most: int | Column) -> Column:
        return F.explode(F.sequence(F.lit(least), F.lit(most)))

    spot = F.xxhash64("vec_id", "vector")
    held = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(spot, F.lit(blocks)).cast("int").alias("block"), "copies")
    # More than k copies of a candidate can't all be among the k best.
    held = held.withColumn("copy", numbers(1, F.least(F.col("copies"), F.lit(k)).cast("int"))).drop("copies", "copy")
    asked = vectors.where("asks").select(
        "query_no", "copies", "vec_id", "vector", F.size("vector").alias("dim"), F.pmod(spot, F.lit(chunks)).cast("int").alias("chunk")
    )
    held, asked = held.withColumn("chunk", numbers(0, chunks - 1)), asked.withColumn("block", numbers(0, blocks - 1))
    at = ["dim", "chunk", "block"]
    found = asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(_meeting(k), FOUND)
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    answers = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return answers.select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
