"""Ranked lexical search as dense blocked matrix products.

A first pass over the documents keeps, of each, its length and how often it holds each term that
some item asks for; the counts of the collection follow from what it stored. In the second pass a
task lays its documents out in tiles of impacts (terms x documents) and multiplies them with tiles
of weights (items x terms), by BLAS in float64. Tiles hold only terms that both the tile's items
and its documents have. Weights and impacts are whole numbers that aren't negative, and a tile of
terms is no wider than keeps the sum of its largest products below 2**53: every partial sum is
exact in whatever order BLAS adds. Sums over tiles are 64-bit integers.

From each tile of scores an item keeps what reaches its k-th score there and so far, ties
included, and of these the first k by (score, id). A task returns k rows per item at most; bands
of tasks are ranked first, then the bands, so no task meets what all tasks found.

Items are a stated query set. Their distinct texts are dealt to groups of about `GROUP_BYTES`, and
a group's terms and weights are broadcast; each group reads the documents once more. One item's
text is never split, so a single text beyond that bound is the size of its group.

Defined results: a null or empty text has no terms, so such a document is found by no item and
counts in no total, and such an item finds nothing. Every document row is a document of its own,
also where rows or ids repeat; null ids rank after the others at equal scores. Item rows with
the same id and text are answered once per row; two texts under one id are two items. Empty
tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.small import stored
from waybill.llm.words import bounded_batches

#: Bytes of item texts whose terms are broadcast together.
GROUP_BYTES = 8 << 20
ITEM_TILE, TERM_TILE, DOC_TILE = 256, 2_048, 1_024
#: Tasks whose rows are ranked together before the rest.
BAND = 256
SCALE = 10**9
EXACT = 2**53
ENTRIES = "doc_id long, n long, terms array<int>, counts array<long>"
FOUND = "item int, doc_id long, score long"

#: Bytes to bytes: A-Z become a-z, what separates terms becomes a space, all else stays.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8; what separates them is below 128, so bytes suffice."""
    return text.translate(TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _sparse(vocabulary):
    """Length of each document and counts of the terms asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
                words = terms(text.as_py() or b"")
                if words:
                    held = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                    for column, value in zip(out, (doc_id, len(words), [t for t, _ in held], [c for _, c in held]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


class Items:
    """Weights of a group of items: for each, its term numbers in ascending order."""

    def __init__(self, item_terms: list[np.ndarray], weights: np.ndarray, documents: int, length: int):
        self.item_terms, self.weights = item_terms, weights
        self.documents, self.length = documents, length
        self.item_tile, self.doc_tile = ITEM_TILE, DOC_TILE
        # An impact is below 10**6, as m is never under 10.
        largest = max(1, int(weights.max(initial=1))) * 10**6
        self.width = max(1, min(TERM_TILE, (EXACT - 1) // largest))

    def tiles(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        for start in range(0, len(self.item_terms), self.item_tile):
            yield start, self.item_terms[start : start + self.item_tile]

    def damping(self, n: np.ndarray) -> np.ndarray:
        return np.array([10 + 90 * int(x) * self.documents // self.length for x in n], np.int64)


class Best:
    """The best k documents of each item of a tile; ties go to the smaller id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.bar = k, np.ones(items, np.int64)
        self.item, self.doc, self.null, self.score = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Takes a tile of scores, items x documents."""
        bar = self.bar
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= bar[:, None])
        if not len(item):
            return
        item_all = np.concatenate([self.item, item])
        doc_all = np.concatenate([self.doc, ids[doc]])
        null_all = np.concatenate([self.null, null[doc]])
        score_all = np.concatenate([self.score, scores[item, doc]])
        order = np.lexsort((doc_all, null_all, -score_all, item_all))
        ranked = item_all[order]
        place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
        kept = order[place < self.k]
        self.item, self.doc, self.null, self.score = (x[kept] for x in (item_all, doc_all, null_all, score_all))
        last = ranked[place == self.k - 1]
        self.bar[last] = score_all[order[place == self.k - 1]]


def _tile_scores(items: Items, tile: list[np.ndarray], term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores of a tile of items for a tile of documents whose impacts are given as triples."""
    asked = np.concatenate(tile)
    row = np.repeat(np.arange(len(tile)), [len(t) for t in tile])
    shared = np.intersect1d(asked, term)
    scores = np.zeros((len(tile), docs), np.int64)
    for start in range(0, len(shared), items.width):
        held = shared[start : start + items.width]
        impacts = np.zeros((len(held), docs))
        at = np.searchsorted(held, term)
        here = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == term)
        impacts[at[here], doc[here]] = impact[here]
        weights = np.zeros((len(tile), len(held)))
        at = np.searchsorted(held, asked)
        here = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == asked)
        weights[row[here], at[here]] = items.weights[asked[here]]
        scores += (weights @ impacts).astype(np.int64)
    return scores


def _scored(group, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = group.value
        best = [(start, tile, Best(len(tile), k)) for start, tile in items.tiles()]
        for batch in batches:
            for at in range(0, batch.num_rows, items.doc_tile):
                part = batch.slice(at, items.doc_tile)
                ids, held, counts = part.column("doc_id"), part.column("terms"), part.column("counts")
                null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
                docs = ids.fill_null(0).to_numpy(zero_copy_only=False)
                sizes = np.diff(held.offsets.to_numpy())
                doc = np.repeat(np.arange(len(docs)), sizes)
                term = held.flatten().to_numpy(zero_copy_only=False)
                count = counts.flatten().to_numpy(zero_copy_only=False)
                damping = items.damping(part.column("n").to_numpy(zero_copy_only=False))
                impact = (SCALE * count) // (1000 * count + 8 * damping[doc])
                for _, tile, kept in best:
                    kept.add(_tile_scores(items, tile, term, doc, impact, len(docs)), docs, null)
        for start, _, kept in best:
            columns = [pa.array(kept.item + start, pa.int32()), pa.array(kept.doc, pa.int64(), mask=kept.null), pa.array(kept.score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(texts: DataFrame, group: DataFrame, k: int) -> DataFrame:
    """item_text, rank, doc_id, score for one group of distinct item texts, whose size is bounded."""
    context = texts.sparkSession.sparkContext
    asked = sorted((r["key"], sorted(set(terms(r["text"].encode())))) for r in group.collect())
    numbers: dict[bytes, int] = {}
    for _, words in asked:
        for word in words:
            numbers.setdefault(word, len(numbers))
    entries = stored(bounded_batches(texts).mapInArrow(_sparse(context.broadcast(numbers)), ENTRIES))
    total = entries.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    # One row for each term of the group.
    holding = {r[0]: r[1] for r in entries.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weights = np.array([weight(total["documents"], holding.get(t, 0)) for t in range(len(numbers))], np.int64)
    item_terms = [np.array(sorted(numbers[w] for w in words), np.int64) for _, words in asked]
    items = Items(item_terms, weights, total["documents"], total["length"] or 1)
    scored = entries.where(F.size("terms") > 0).mapInArrow(_scored(context.broadcast(items), k), FOUND)
    banded = scored.withColumn("band", (F.spark_partition_id() / BAND).cast("int"))
    ranked = _first(_first(banded, ["item", "band"], k).drop("rank"), ["item"], k)
    names = texts.sparkSession.createDataFrame([(i, key) for i, (key, _) in enumerate(asked)], "item int, item_text string")
    return ranked.join(names, "item").select("item_text", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item, above 0."""
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), "text")
    # By content, as equal texts have equal answers; two rows of one id are told apart by it.
    asked = stored(items.select(F.col(item_key).alias("item_id"), F.sha2(F.col("text"), 256).alias("item_text"), "text"))
    distinct = asked.where(F.length("text") > 0).groupBy("item_text").agg(F.first("text").alias("text"))
    distinct = stored(distinct.withColumnRenamed("item_text", "key"))
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    group: Column = F.pmod(F.xxhash64("key"), F.lit(groups))
    parts = [_search(texts, distinct.where(group == g), k) for g in range(groups)] if size else []
    if not parts:
        parts = [items.sparkSession.createDataFrame([], "item_text string, rank int, doc_id long, score long")]
    answers = parts[0]
    for part in parts[1:]:
        answers = answers.unionByName(part)
    return asked.drop("text").join(answers, "item_text").select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ranked_search(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS t FROM documents
), q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark
), total AS (
  SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
), asked AS (
  SELECT q, item_id, unnest(t) AS term FROM q
), tf AS (
  SELECT d, doc_id, n, term, count(*) AS tf
  FROM (SELECT d, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked)
  GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), s AS (
  SELECT q, item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL
), r AS (
  SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
