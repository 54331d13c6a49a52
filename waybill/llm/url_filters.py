"""URL filters: host rules first, then path templates judged by the labels of their pages.

Paths are read as segments from the host down, and each level is one pass over the distinct
(host, path) pairs with their counts. At a node a segment value that holds a fair share of the
pages stays a literal branch; all others are variable and fall into a wildcard for their shape
(`{num}`, `{hex}`, `{slug}` with the file ending kept). Literal branches of one node whose pages go
on alike - as often ending there, as often into each shape, as often labelled to block or to
allow - are merged: a Hoeffding bound on each difference of shares has to hold. A node has at most
1 / `LITERAL_SHARE` literal branches, so comparing them is bounded whatever the table's size.
Where a path ends, its branch is its template. A branch's purity is the share of pages labelled to
block among its labelled pages, smoothed from the host down: the purity of the branch above counts
as `PRIOR` pages, that above the host is one half. Templates of `PURITY` or more, of whose pages
`LABELLED_SHARE` or more are labelled to block, are rejected with all their pages.

Rows move as distinct paths with counts, never as pages; one join brings the verdicts to the pages.

Defined results: a null URL, or one without `://`, has an empty host and path, and no rule and no
labels, and is allowed. A rule fits its host and all its subdomains if the path starts with the
rule's; the longest fitting rule wins. Without a label a template is allowed. Repeated rows are
judged alike. An empty table gives an empty result. Levels beyond `MAX_LEVELS` fall into one
wildcard `{more}`. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.small import stored

#: host/path and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that label a page to block where the host or path has one of them as a token.
BLOCK_WORDS = ("adult", "ads", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "xxx")
#: A literal branch has at least this many pages and this share of its node's pages.
LITERAL_PAGES, LITERAL_SHARE = 10, 0.02
#: Confidence of the merge test: chance that two like branches are held apart on one feature.
MERGE_ALPHA = 0.05
#: Pages that the purity of the branch above weighs, the least purity and the least share of pages labelled to block of a rejected template.
PRIOR, PURITY, LABELLED_SHARE = 2, 0.9, 0.25
MAX_LEVELS = 12
#: Where a path goes on after a segment.
NEXT = ("end", "{num}", "{hex}", "{slug}")
FEATURES = [*NEXT, "bad", "good"]
END = "$"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.substring_index(_after(url), "/", 1), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    of, slash, start = rule.partition("/")
    return ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + start))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: -len(r[0]))
    return F.coalesce(*[F.when(_fits(name, host, path), F.lit(name)) for name, _ in longest], F.lit(None).cast("string"))


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*[F.when(rule == name, F.lit(v)) for name, v in rules], F.lit(None).cast("string"))


def shape(segment: Column) -> Column:
    """Wildcard of a variable segment."""
    stem = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    ending = F.translate(F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(_stem_shape(stem), ending)


def _stem_shape(stem: Column) -> Column:
    return (
        F.when(stem.rlike("^[0-9]+$"), F.lit("{num}"))
        .when(stem.rlike("^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]"), F.lit("{hex}"))
        .otherwise(F.lit("{slug}"))
    )


def _similar(a: dict, b: dict) -> bool:
    """No share of the two branches differs by more than chance would let it."""
    bound = math.sqrt(0.5 * math.log(2 / MERGE_ALPHA)) * (1 / math.sqrt(a["pages"]) + 1 / math.sqrt(b["pages"]))
    return all(abs(a[f] / a["pages"] - b[f] / b["pages"]) <= bound for f in FEATURES)


def merged(branches: list[dict]) -> dict[str, str]:
    """The name that each literal branch of a node goes by, from those it is merged with.

    Larger branches first; a branch joins the first group whose pooled pages it resembles.
    """
    groups: list[tuple[dict, list[str]]] = []
    for branch in sorted(branches, key=lambda b: (-b["pages"], b["segment"])):
        for pool, names in groups:
            if _similar(pool, branch):
                names.append(branch["segment"])
                for f in ["pages", *FEATURES]:
                    pool[f] += branch[f]
                break
        else:
            groups.append((dict(branch), [branch["segment"]]))
    return {n: "|".join(sorted(map(_literal, names))) for _, names in groups for n in names}


def _literal(segment: str) -> str:
    """A segment in which nothing reads like a wildcard or a merged branch."""
    return segment.replace("%", "%25").replace("{", "%7B").replace("|", "%7C")


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of literal branches; those of a node follow each other."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for (host, node), branches in groupby(rows(), key=lambda r: (r["host"], r["node"])):
        names = merged(list(branches))
        columns = [[host] * len(names), [node] * len(names), list(names), list(names.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "node", "segment", "name"])


def _literals(now: DataFrame) -> DataFrame:
    """host, node, segment, name of the literal branches of this level."""
    going = F.when(F.coalesce("after", F.lit("")) == "", F.lit("end")).otherwise(_stem_shape(F.regexp_replace("after", r"\.[A-Za-z]{1,5}$", "")))
    counts = [F.sum(F.when(F.col("going") == f, F.col("pages")).otherwise(0)).alias(f) for f in NEXT]
    values = now.withColumn("going", going).groupBy("host", "node", "segment")
    values = stored(values.agg(F.sum("pages").alias("pages"), *counts, F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    # The sums of a node are combined before they meet; a window would gather its values.
    nodes = values.groupBy("host", "node").agg(F.sum("pages").alias("of"))
    kept = values.where((F.col("pages") >= LITERAL_PAGES) & (F.col("segment") != "")).join(nodes, ["host", "node"])
    kept = kept.where(F.col("pages") >= LITERAL_SHARE * F.col("of")).drop("of")
    dealt = kept.repartition("host", "node").sortWithinPartitions("host", "node")
    return dealt.mapInArrow(_merging, "host string, node string, segment string, name string")


def templates(paths: DataFrame) -> DataFrame:
    """`paths` (host, path, pages, bad, good; each pair once) with the template of each path."""
    segments = F.split(F.substring(F.col("path"), F.lit(2), F.length("path")), "/")
    now = paths.withColumn("segments", F.when(F.length("path") > 0, segments).otherwise(F.array().cast("array<string>")))
    now = stored(now.withColumn("node", F.lit("")))
    done: list[DataFrame] = []
    for level in range(MAX_LEVELS):
        ended = F.size("segments") <= level
        done.append(now.where(ended).withColumn("template", F.concat("node", F.lit(END))))
        now = now.where(~ended)
        if now.isEmpty():
            break
        now = now.withColumns({"segment": F.get("segments", F.lit(level)), "after": F.get("segments", F.lit(level + 1))})
        named = now.join(_literals(now), ["host", "node", "segment"], "left")
        wild = F.when(F.col("segment") == "", F.lit("")).otherwise(shape(F.col("segment")))
        branch = F.concat("node", F.lit("/"), F.coalesce("name", wild))
        now = stored(named.withColumn("node", branch).drop("segment", "after", "name"))
    else:
        ended = F.size("segments") <= MAX_LEVELS
        more = F.when(ended, F.lit("")).otherwise(F.lit("/{more}"))
        done.append(now.withColumn("template", F.concat("node", more, F.lit(END))))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("segments", "node")


def rejected(paths: DataFrame, purity: float = PURITY) -> DataFrame:
    """host, template, purity of the templates to reject. paths: see `templates`, with a template."""
    labels = [F.sum(c).alias(c) for c in ("pages", "bad", "good")]
    leaves = stored(paths.groupBy("host", "template").agg(*labels))
    # A template's branches from the host down, the last one being itself.
    parts = F.split("template", "/")
    branches = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    chains = leaves.select("host", "template", F.posexplode(branches).alias("depth", "branch"))
    chains = chains.unionByName(leaves.select("host", "template", F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("branch")))
    held = chains.join(leaves.drop("pages"), ["host", "template"])
    # One row for each branch and depth; templates of a host are few, as variable segments are wildcards.
    sums = held.groupBy("host", "depth", "branch").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    joined = chains.alias("c").join(
        sums.alias("s"), (F.col("c.host") == F.col("s.host")) & (F.col("c.depth") == F.col("s.depth")) & F.col("c.branch").eqNullSafe(F.col("s.branch"))
    )
    step = F.struct(F.col("c.depth").alias("depth"), "bad", "good")
    steps = joined.groupBy(F.col("c.host").alias("host"), F.col("c.template").alias("template")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    smoothed = F.aggregate(
        "steps", F.lit(0.5), lambda above, x: (x["bad"] + PRIOR * above) / (x["bad"] + x["good"] + PRIOR)
    )
    scored = steps.withColumn("purity", smoothed).join(leaves, ["host", "template"])
    enough = F.col("bad") >= LABELLED_SHARE * F.col("pages")
    return scored.where(enough & (F.col("purity") >= purity)).select("host", "template", "purity")


def judged(pages: DataFrame, label: Column, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template of every page.

    label: 1 for a page known to be unwanted, 0 for one known to be wanted, else null; it may use
    host, path and rule.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", label)
    sums = rows.where(F.col("host") != "").groupBy("host", "path").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("label") == 1).alias("bad"),
        F.count_if(F.col("label") == 0).alias("good"),
    )
    shaped = stored(templates(stored(sums)))
    bad = rejected(shaped).select("host", "template", F.lit(True).alias("reject"))
    known = shaped.join(bad, ["host", "template"], "left").select("host", "path", "template", "reject")
    # Each path once: where very many pages share one, the adaptive join splits them.
    joined = rows.join(known, ["host", "path"], "left")
    method = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), method)
    return joined.select(F.col("page_id").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template")


def known_label(rules=RULES, words=BLOCK_WORDS) -> Column:
    """Labels for `judged`: 0 where a rule allows, 1 where a token of host or path is a block word.

    What a rule blocks is no label: it says nothing on pages beyond the rule, and a branch that
    pools some of them with others would carry it there.
    """
    tokens = F.split(F.lower(F.concat("host", F.lit("/"), "path")), "[^a-z]+")
    worded = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return F.when(verdict_of(F.col("rule"), rules) == "allow", F.lit(0)).when(worded, F.lit(1))


def op12(spark, sf_dir: str) -> DataFrame:
    """Every page is judged; the labels are those of the allowing rules and the block words."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), known_label())
