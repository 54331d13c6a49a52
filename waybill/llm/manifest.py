"""Merkle manifest of a dataset: per-source trees under one root, with a witness for every row.

Leaves of a tree are numbered by range partitions: a partition is sorted, and its rows are shifted
by what earlier partitions hold of the tree. Aligned blocks of 3**`BLOCK_LEVELS` leaves are then
appended leaf by leaf. Each open subtree carries a partial witness, one entry per level; a sibling
that is completed later extends the entries of the subtrees before it, and three of them close
into their parent. A block leaves its root, which is appended to the next level's tree in just the
same way, until a tree is one block; the roots of all trees are appended to the last tree. A row's
witness is its own entries, then its block's, then its tree's. So texts are hashed where they are
read, only digests move, a task holds one block, and one source of any size is many blocks.

Defined results: rows of one source are in the order of the id, null first, then of the leaf;
repeated rows are leaves of their own; a null source is a tree of its own, the first one; a null
id isn't tampered with; an empty table has no rows and so no root. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.small import stored

FAN = 3
#: Levels that one task completes: blocks of 3**7 = 2,187 leaves.
BLOCK_LEVELS = 7
SPAN = FAN**BLOCK_LEVELS
#: Rows of an Arrow batch of witnesses.
OUT_ROWS = 2_000
ENTRY = pa.struct([("left", pa.string()), ("right", pa.string())])
NO_ENTRIES = "array<struct<left:string,right:string>>"


def node_hash(children: str) -> str:
    return sha256(children.encode()).hexdigest()


class Subtree:
    """A complete subtree: its node, and what its witness has of the run it stands in."""

    __slots__ = ("node", "first", "entry")

    def __init__(self, node: str, first: int, left: str):
        self.node, self.first, self.entry = node, first, [left, ""]


class Appender:
    """Appends the leaves of an aligned block; `witnesses` are complete once it is closed.

    A witness is a list of [left, right]: the digests of the siblings before and after, by level.
    All leaves below a subtree share its entry, so extending it is one step for all of them.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[Subtree]] = [[] for _ in range(levels)]
        self.witnesses: list[list[list[str]]] = []
        self.root: str | None = None

    def append(self, leaf: str) -> None:
        self.witnesses.append([])
        self._complete(0, leaf, len(self.witnesses) - 1)

    def _complete(self, level: int, node: str, first: int) -> None:
        if level == self.levels:
            self.root = node
            return
        run = self.open[level]
        for earlier in run:
            earlier.entry[1] += node
        new = Subtree(node, first, "".join(x.node for x in run))
        run.append(new)
        for witness in self.witnesses[first:]:
            witness.append(new.entry)
        if len(run) == FAN:
            self._parent(level)

    def _parent(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._complete(level + 1, node_hash("".join(x.node for x in run)), run[0].first)

    def close(self) -> str:
        """No more leaves: the last runs stay as short as they are. Returns the block's root."""
        for level in range(self.levels):
            if self.open[level]:
                self._parent(level)
        return self.root


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _batch_of(parts: list[pa.RecordBatch], witnesses: list, roots: list[str]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    entries = [e for w in witnesses for e in w]
    values = pa.StructArray.from_arrays(
        [pa.array([e[i] for e in entries], pa.string()) for i in (0, 1)], fields=list(ENTRY)
    )
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in witnesses])]).astype(np.int32)
    path = pa.ListArray.from_arrays(pa.array(offsets), values)
    columns = [rows[n].combine_chunks() for n in rows.column_names] + [path, pa.array(roots, pa.string())]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=[*rows.column_names, "path", "block_root"])


def _appended(batches: Iterator[pa.RecordBatch], levels: int, out_rows: int) -> Iterator[pa.RecordBatch]:
    """Adds to the rows of blocks, given in order, their entries and the block's root."""
    block, now = None, None
    parts: list[pa.RecordBatch] = []
    witnesses: list = []
    roots: list[str] = []

    def finish() -> None:
        roots.extend([block.close()] * len(block.witnesses))
        witnesses.extend(block.witnesses)

    for batch in batches:
        trees, blocks = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
        nodes, sizes = batch.column("node").to_pylist(), batch.column("size").to_numpy()
        cuts = np.flatnonzero((trees[1:] != trees[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            if start == stop:
                continue
            here = (trees[start], blocks[start])
            if here != now:
                if block:
                    finish()
                if len(roots) >= out_rows:
                    yield _batch_of(parts, witnesses, roots)
                    parts, witnesses, roots = [], [], []
                block, now = Appender(min(levels, height(int(sizes[start])))), here
            parts.append(batch.slice(start, stop - start))
            for node in nodes[start:stop]:
                block.append(node)
    if block:
        finish()
        yield _batch_of(parts, witnesses, roots)


def _blocks(nodes: DataFrame) -> DataFrame:
    """`nodes` (tree, pos, size, node and others) with block, path and block_root."""
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("long"))
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, path {NO_ENTRIES}, block_root string"
    levels, out_rows = BLOCK_LEVELS, OUT_ROWS
    return dealt.mapInArrow(lambda batches: _appended(batches, levels, out_rows), schema)


def climbed(nodes: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with the entries up to their block's root; and, by tree and block, those above and the tree's root.

    nodes: tree, pos (from 0), size of the tree, node. largest: the size of the largest tree.
    """
    local = stored(_blocks(nodes))
    tops = local.where(F.col("pos") % SPAN == 0)
    if largest <= SPAN:
        return local, tops.select("tree", "block", F.expr(f"cast(array() AS {NO_ENTRIES})").alias("above"), F.col("block_root").alias("tree_root"))
    size = F.ceil(F.col("size") / SPAN).cast("long")
    roots = tops.select("tree", F.col("block").alias("pos"), size.alias("size"), F.col("block_root").alias("node"))
    upper, above = climbed(roots, math.ceil(largest / SPAN))
    joined = upper.join(above, ["tree", "block"])
    return local, joined.select("tree", F.col("pos").alias("block"), F.concat("path", "above").alias("above"), "tree_root")


def _ranged(rows: DataFrame, by: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """`rows` in sorted range partitions, by null first, then `order`; and the counts of each partition and group.

    The counts have the group's size before each partition as `_before`: their window sees one
    row for each partition.
    """
    order = [*[F.asc_nulls_first(c) for c in by], *order]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = ranged.groupBy(*by, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, stored(counts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0))))


def _placed(ranged: DataFrame, counts: DataFrame, by: list[str], out: str) -> DataFrame:
    """The ranged rows with their place from 0 within `by`, and the further columns of `counts`."""
    named = counts
    same = F.shiftright("_at", 33) == F.col("_part")
    for c in by:
        named = named.withColumnRenamed(c, f"_by_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = ranged.join(named, same).withColumn(out, F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_at", "_part", "_first", "_before", "_count", *[f"_by_{c}" for c in by])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    """Each field as its size in UTF-8, a colon and its value, `-` for null."""
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def manifest(
    rows: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", seen: dict[str, Column] | None = None
) -> DataFrame:
    """key, leaf, subroot, root, path and seen_leaf of every row.

    seen: fields as they are found later, if other than those the manifest was made of.
    path holds the siblings' digests, by level from the leaf up: `folded` leads a leaf to the root.
    """
    seen = seen or {}
    leaves = rows.select(
        F.col(group).alias("source"),
        F.col(key).alias("doc_id"),
        leaf_hash([F.col(f) for f in fields]).alias("node"),
        leaf_hash([seen.get(f, F.col(f)) for f in fields]).alias("seen_leaf"),
        # Rows alike in all else may stand in any order; told apart, they needn't share a range.
        F.monotonically_increasing_id().alias("spot"),
    )
    ranged, counts = _ranged(leaves, ["source"], [F.asc_nulls_first("doc_id"), F.asc("node"), F.asc("spot")])
    trees = stored(counts.groupBy("source").agg(F.sum("_count").alias("size")))
    named = stored(_placed(*_ranged(trees, [], [F.asc_nulls_first("source")]), [], "tree"))
    facts = named.agg(F.count("*").alias("trees"), F.max("size").alias("largest")).first()
    # A source's tree and size go to its partitions, not to its rows.
    names = named.select(F.col("source").alias("_source"), "tree", "size")
    counts = counts.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    nodes = _placed(ranged, counts, ["source"], "pos").drop("source", "spot")
    local, above = climbed(nodes, facts["largest"] or 0)
    above = stored(above)
    subroots = above.where("block = 0").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(facts["trees"]).cast("long").alias("size"), F.col("tree_root").alias("node")
    )
    forest, over = climbed(subroots, facts["trees"])
    last = forest.join(over.withColumnRenamed("above", "over").withColumnRenamed("tree_root", "root"), ["tree", "block"])
    last = last.select(F.col("pos").alias("tree"), F.concat("path", "over").alias("last"), "root")
    # Blocks meet the trees' entries, so rows meet them block by block and no source is one join key.
    blocks = above.join(last, "tree").select("tree", "block", F.concat("above", "last").alias("above"), F.col("tree_root").alias("subroot"), "root")
    whole = local.join(blocks, ["tree", "block"])
    return whole.select(
        F.col("doc_id").alias(key), F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"), "seen_leaf"
    )


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda e: F.concat(e["left"], e["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings' digests lead to."""
    return F.aggregate(path, leaf, lambda node, e: F.sha2(F.concat(e["left"], node, e["right"]), 256))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = manifest(documents, FIELDS, seen={"text": text})
    made = made.withColumn("folded_root", folded(F.col("seen_leaf"), F.col("path")))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


_BIT = "list_reduce(list_prepend({x}, [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, "
    "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda a, b: " + _BIT.format(x="xor(a, b)") + "))"
)

OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_sql_leaf('text')} AS leaf,
         {_sql_leaf("CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS seen
  FROM documents
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM d
), tree AS (
  SELECT source, 0 AS level, pos, size, leaf AS node FROM leaf
  UNION ALL
  SELECT source, level + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE size > 1 GROUP BY source, level, pos // 3
), forest AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size, node FROM tree WHERE size = 1
  UNION ALL
  SELECT level + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM forest WHERE size > 1 GROUP BY level, pos // 3
), up AS (
  SELECT r, source, 0 AS level, pos, size, seen AS node, '' AS siblings FROM leaf
  UNION ALL
  SELECT r, any_value(u.source), u.level + 1, u.pos // 3, any_value((u.size + 2) // 3),
         sha256(string_agg(CASE WHEN t.pos = u.pos THEN u.node ELSE t.node END, '' ORDER BY t.pos)),
         any_value(u.siblings) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> u.pos), '')
  FROM up u JOIN tree t ON t.source IS NOT DISTINCT FROM u.source AND t.level = u.level AND t.pos // 3 = u.pos // 3
  WHERE u.size > 1 GROUP BY r, u.level, u.pos
), numbered AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM tree WHERE size = 1
), over_sources AS (
  SELECT r, 0 AS level, n.pos, n.size, node, siblings FROM up u JOIN numbered n ON n.source IS NOT DISTINCT FROM u.source WHERE u.size = 1
  UNION ALL
  SELECT r, u.level + 1, u.pos // 3, any_value((u.size + 2) // 3),
         sha256(string_agg(CASE WHEN t.pos = u.pos THEN u.node ELSE t.node END, '' ORDER BY t.pos)),
         any_value(u.siblings) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> u.pos), '')
  FROM over_sources u JOIN forest t ON t.level = u.level AND t.pos // 3 = u.pos // 3
  WHERE u.size > 1 GROUP BY r, u.level, u.pos
)
SELECT doc_id, leaf, subroot, f.node AS root, sha256(o.siblings) AS proof_sha256, o.node AS folded_root, o.node = f.node AS verified
FROM leaf JOIN numbered n ON n.source IS NOT DISTINCT FROM leaf.source
JOIN over_sources o ON o.r = leaf.r AND o.size = 1, (SELECT node FROM forest WHERE size = 1) f
"""
