"""Mixing sources to target weights with a hierarchical token budget.

The sources form a tree, here domain, language, source. A budget enters at the root and is split
among the children of each node by weight. A child can't take more than the tokens below it times
the permitted epochs; what it can't take goes to its siblings by their weights, and only what no
sibling can take is missing one level up, where the same rule has already moved it to the
ancestor's siblings. With capacities known before the split, both are one water-filling pass per
level, in closed form: sorted by capacity per weight, the children that are filled up come first.

A leaf's quota is then taken from seeded epochs: every full epoch takes all its documents, the
last one takes the documents in the order of a digest of (seed, epoch, id) as long as their
tokens stay within the rest. The digest at which a leaf stops is found from token sums per digest
bucket and the rows of one bucket, so no leaf is ever sorted as a whole, and the texts never move.

Defined results: a null level value is the empty name; a weight that isn't named is 1, a weight
of 0 takes nothing; a null or blank text has no tokens and is in every epoch its leaf finishes, and
in the last by its digest; a leaf without tokens is taken once; rows that repeat an id fall on the
same side of the cut; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.small import broadcast_up_to, stored
from waybill.llm.words import word_array

#: Hex digits of the digest that make a bucket: 4,096 buckets for each leaf.
BUCKET_DIGITS = 3
BROADCAST_ROWS = 200_000
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Mix:
    """levels: name and SQL expression, root first; weights: level -> value -> whole number."""

    levels: tuple[tuple[str, str], ...]
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 75
    max_epochs: int = 2
    seed: int = 17
    tokens: Column | None = None

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.levels]


#: The domain of a source is given by its number, as the tables name none.
DOMAIN_SQL = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int), 0) % 4)"
MIX = Mix(
    levels=(("domain", DOMAIN_SQL), ("language", "lang"), ("leaf", "source")),
    weights={
        "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
        "language": {"en": 5, "de": 2, "fr": 2, "es": 1},
    },
)


def _leveled(docs: DataFrame, mix: Mix) -> list[Column]:
    return [F.coalesce(F.expr(sql).cast("string"), F.lit("")).alias(f"_{name}") for name, sql in mix.levels]


def _weight(mix: Mix, name: str) -> Column:
    given = mix.weights.get(name, {})
    value = F.lit(1)
    for key, weight in given.items():
        value = F.when(F.col(f"_{name}") == key, F.lit(weight)).otherwise(value)
    return value.cast(WIDE)


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `quota`: the parent's `budget` split by `weight` within `capacity`.

    Rounded by cumulated shares, so that the quotas of a parent add up to its budget, or to the
    capacity below it if that is less.
    """
    by_ratio = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), name)
    filled = children.where("weight > 0").withColumns(
        {
            "_before": F.coalesce(F.sum("capacity").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(WIDE),
            "_left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).cast(WIDE),
        }
    )
    filled = filled.withColumn("_full", F.expr("capacity * _left <= weight * (budget - _before)"))
    group = Window.partitionBy(*parent)
    so_far = Window.partitionBy(*parent).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    open_weight = F.when(F.col("_full"), F.lit(0)).otherwise(F.col("weight")).cast(WIDE)
    filled = filled.withColumns(
        {
            "_rest": (F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(F.lit(0))).over(group)).cast(WIDE),
            "_open": F.sum(open_weight).over(group).cast(WIDE),
            "_to": F.sum(open_weight).over(so_far).cast(WIDE),
        }
    )
    share = F.expr("(_to * _rest) div _open - ((_to - weight) * _rest) div _open")
    quota = F.when(F.col("_full"), F.col("capacity")).otherwise(share).cast("long")
    return filled.withColumn("quota", quota).drop("_before", "_left", "_full", "_rest", "_open", "_to")


def quotas(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Levels, tokens and quota of every leaf; leaves: one row each with its tokens."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    nodes = leaves.withColumn("_root", F.lit(0)).withColumn("budget", F.lit(total * mix.budget_percent // 100).cast("long"))
    for depth, name in enumerate(mix.names):
        parent = ["_root", *[f"_{n}" for n in mix.names[:depth]]]
        children = nodes.groupBy(*parent, f"_{name}").agg(
            F.first("budget").cast(WIDE).alias("budget"),
            (F.sum("tokens") * mix.max_epochs).cast(WIDE).alias("capacity"),
        )
        split = water_fill(children.withColumn("weight", _weight(mix, name)), parent, f"_{name}")
        key = [*parent, f"_{name}"]
        nodes = nodes.drop("budget").join(split.select(*key, F.col("quota").alias("budget")), key)
    return nodes.withColumnRenamed("budget", "quota").drop("_root")


def _digest(mix: Mix, epoch: Column, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def cuts(items: DataFrame, mix: Mix, key: str = "doc_id") -> DataFrame:
    """Per leaf: `_full` epochs taken whole, and `_upto`, the digest the next one is taken to.

    items: key, level columns and `tokens`; stored.
    """
    at = [f"_{n}" for n in mix.names]
    leaves = stored(quotas(stored(items.groupBy(*at).agg(F.sum("tokens").alias("tokens"))), mix))
    leaves = leaves.withColumns(
        {
            "_full": F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)),
            "_rest": F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(F.lit(0)),
        }
    ).select(*at, "_full", "_rest")
    small = broadcast_up_to(leaves, BROADCAST_ROWS)
    placed = items.join(small, at).withColumn("_digest", _digest(mix, F.col("_full"), key))
    placed = placed.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*at, "_bucket").agg(F.sum("tokens").alias("tokens"))
    upward = Window.partitionBy(*at).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_up", F.sum("tokens").over(upward)).join(broadcast_up_to(leaves, BROADCAST_ROWS), at)
    cut = sums.where("_up > _rest").groupBy(*at).agg(
        F.min_by(F.struct(F.col("_bucket").alias("b"), (F.col("_up") - F.col("tokens")).alias("u")), "_bucket").alias("_cut")
    )
    cut = stored(cut)
    inside = placed.join(broadcast_up_to(cut, BROADCAST_ROWS), at).where(F.col("_bucket") == F.col("_cut")["b"])
    # Equal digests are peers: a range frame takes them together.
    upward = Window.partitionBy(*at).orderBy("_digest").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_up", F.sum("tokens").over(upward) + F.col("_cut")["u"])
    last = inside.where("_up <= _rest").groupBy(*at).agg(F.max("_digest").alias("_last"))
    return stored(
        leaves.join(cut, at, "left")
        .join(last, at, "left")
        .select(*at, "_full", F.when(F.col("_rest") > 0, F.coalesce("_last", F.col("_cut")["b"])).otherwise("").alias("_upto"))
    )


def _epochs(rows: DataFrame, mix: Mix, key: str, leaf_cuts: DataFrame) -> DataFrame:
    """One row per selected copy with its `_epoch`."""
    at = [f"_{n}" for n in mix.names]
    marked = rows.join(broadcast_up_to(leaf_cuts, BROADCAST_ROWS), at)
    copies = F.col("_full") + F.when(_digest(mix, F.col("_full"), key) <= F.col("_upto"), 1).otherwise(0)
    taken = marked.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))


def items_of(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    tokens = F.size(word_array(F.col(text))) if mix.tokens is None else mix.tokens
    return stored(docs.select(key, *_leveled(docs, mix), tokens.cast("long").alias("tokens")))


def mixed(docs: DataFrame, mix: Mix = MIX, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The selected rows with all their columns, once per epoch that takes them."""
    leaf_cuts = cuts(items_of(docs, mix, key, text), mix, key)
    # Columns of the caller may have any name: they travel in one struct.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), *_leveled(docs, mix))
    return _epochs(rows, mix, "_key", leaf_cuts).select("_row.*")


def selection(docs: DataFrame, mix: Mix = MIX, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, levels, n_tokens and epoch of every selected copy."""
    items = items_of(docs, mix, key, text)
    taken = _epochs(items, mix, key, cuts(items, mix, key))
    return taken.select(
        key,
        *[F.col(f"_{n}").alias(n) for n in mix.names],
        F.col("tokens").alias("n_tokens"),
        F.col("_epoch").alias("epoch"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return selection(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fill_sql(name: str, parents: list[str], source: str) -> str:
    """SQL of one level; `source` has the leaves with the parent's budget."""
    key = ", ".join([*parents, name])
    group = ", ".join(parents) or "1"
    weights = {
        "domain": "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END",
        "language": "CASE language WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
    }.get(name, "1")
    return f"""
{name}_c AS (
  SELECT {key}, any_value(budget)::HUGEINT AS budget, (sum(tokens) * 2)::HUGEINT AS capacity, {weights}::HUGEINT AS weight
  FROM {source} GROUP BY {key}
), {name}_r AS (
  SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {group} ORDER BY capacity / weight, {name}
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
         sum(weight) OVER (PARTITION BY {group} ORDER BY capacity / weight, {name}
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS lef
  FROM {name}_c
), {name}_f AS (SELECT *, capacity * lef <= weight * (budget - before) AS ful FROM {name}_r),
{name}_o AS (
  SELECT *, budget - sum(CASE WHEN ful THEN capacity ELSE 0 END) OVER (PARTITION BY {group})::HUGEINT AS rest,
         sum(CASE WHEN ful THEN 0 ELSE weight END) OVER (PARTITION BY {group})::HUGEINT AS op,
         sum(CASE WHEN ful THEN 0 ELSE weight END) OVER (PARTITION BY {group} ORDER BY {name} ROWS UNBOUNDED PRECEDING)::HUGEINT AS upto
  FROM {name}_f
), {name}_q AS (
  SELECT {key}, CASE WHEN ful THEN capacity ELSE (upto * rest) // op - ((upto - weight) * rest) // op END AS quota FROM {name}_o
), {name}_n AS (
  SELECT s.* EXCLUDE (budget), q.quota AS budget FROM {source} s JOIN {name}_q q USING ({key})
)"""


OP10_SQL = (
    r"""
WITH items AS (
  SELECT doc_id,
         'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS int), 0) % 4) AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS leaf,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents
), leaves AS (
  SELECT domain, language, leaf, sum(tokens)::BIGINT AS tokens,
         (sum(sum(tokens)) OVER () * 75 // 100)::HUGEINT AS budget
  FROM items GROUP BY domain, language, leaf
),"""
    + ",".join(
        [
            _fill_sql("domain", [], "leaves"),
            _fill_sql("language", ["domain"], "domain_n"),
            _fill_sql("leaf", ["domain", "language"], "language_n"),
        ]
    )
    + r""", cut AS (
  SELECT domain, language, leaf, CASE WHEN tokens > 0 THEN (budget // tokens)::INT ELSE 1 END AS ful,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM leaf_n
), ordered AS (
  SELECT items.*, ful, rest,
         sum(tokens) OVER (PARTITION BY domain, language, leaf
                           ORDER BY md5('17|' || ful || '|' || coalesce(doc_id::VARCHAR, ''))) AS up
  FROM items JOIN cut USING (domain, language, leaf)
)
SELECT doc_id, domain, language, leaf, tokens AS n_tokens,
       unnest(range(0, ful + CASE WHEN rest > 0 AND up <= rest THEN 1 ELSE 0 END))::INT AS epoch
FROM ordered
"""
)
