"""Quality rules as a short-circuit cascade.

Each rule rejects a text on a few counted features. On a sample the operator measures what a
rule costs and which sampled rows it rejects, then puts the rules in the order of rejections
per cost among the rows that earlier rules let pass. The main pass is one CASE expression:
a row stops at the first rule that rejects it, so later rules cost nothing for it. The order
changes the time only, never a verdict.

Defined results: a null text has no words and so fails `few_words`; an empty table gives an
empty table; repeated rows are judged one by one; other columns pass through untouched, also
when they are named like a feature. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.small import stored
from waybill.llm.words import word_array

#: Rows that the cost and selectivity estimates read; only the order of the rules follows.
SAMPLE_ROWS = 1_000
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once per row.

    An expression named inside a lambda is evaluated for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word_chars(text: Column, words: Column) -> Column:
    return F.char_length(F.array_join(words, ""))


def _symbols(text: Column, words: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _dup_lines(text: Column, words: Column) -> Column:
    return bound(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _repeat_words(text: Column, words: Column) -> Column:
    """Words that lie in a window of five words found twice or more.

    Windows are compared by 64-bit hashes of their five words, chained so that word borders count.
    """
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(WINDOW)]),
        ),
    )

    def covered(keys: Column) -> Column:
        twice = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(twice, bound(_repeated_starts(keys), _covered_words)).otherwise(0)

    return F.coalesce(bound(windows, covered), F.lit(0))


def _repeated_starts(keys: Column) -> Column:
    """Ascending positions of the keys that occur twice or more."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def of(pairs: Column) -> Column:
        def shared(x: Column, i: Column) -> Column:
            before = F.get(pairs, i - 1)["k"] == x["k"]
            after = F.get(pairs, i + 1)["k"] == x["k"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, shared), lambda x: x["i"]))

    return bound(placed, of)


def _covered_words(starts: Column) -> Column:
    """Length of the union of the windows at ascending starts."""
    gaps = F.transform(
        starts,
        lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))),
    )
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


#: Feature by name: a count worked out from the text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": _word_chars,
    "n_symbols": _symbols,
    "n_lines": lambda text, words: F.size(_lines(text)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text; `rejects` gets a function from a feature's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]
    base: bool = False


RULES = (
    Rule("few_words", lambda f: f("n_words") < 10, base=True),
    Rule("repeats", lambda f: 100 * f("n_repeat_words") > 20 * f("n_words"), base=True),
    Rule("symbols", lambda f: 100 * f("n_symbols") > 100 * f("n_words")),
    Rule("dup_lines", lambda f: 100 * f("n_dup_lines") > 30 * f("n_lines")),
    Rule("short_words", lambda f: f("word_chars") < 2 * f("n_words")),
    Rule("long_words", lambda f: f("word_chars") > 40 * f("n_words")),
)


def features(text: Column) -> Column:
    """Struct of all features of a text."""
    body = F.coalesce(text, F.lit(""))
    return bound(
        word_array(text),
        lambda words: F.struct(*[make(body, words).cast("long").alias(n) for n, make in FEATURES.items()]),
    )


def _lazy(rules: tuple[Rule, ...], text: Column) -> Column:
    """Name of the first rule that rejects, null for none; counts only what it must."""
    body = F.coalesce(text, F.lit(""))

    def first(words: Column) -> Column:
        def feature(name: str) -> Column:
            return FEATURES[name](body, words).cast("long")

        return F.coalesce(*[F.when(r.rejects(feature), F.lit(r.name)) for r in rules])

    return bound(word_array(text), first)


def estimates(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> list[dict]:
    """The rules in cascade order, with sampled cost (seconds) and rejections.

    The sample is drawn from all rows and stored; each rule runs over it alone, twice, and the
    faster run counts, less the time of reading and splitting the texts.
    """
    total = docs.count()
    if total == 0 or len(rules) < 2:
        return [{"rule": r, "seconds": 0.0, "rejected": 0} for r in rules]
    sample = stored(docs.select(F.col(text).alias("text")).sample(min(1.0, SAMPLE_ROWS / total), seed=7))

    def seconds(verdict: Column) -> float:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count_if(verdict)).collect()
            runs.append(time.perf_counter() - start)
        return min(runs)

    col = F.col("text")
    least = seconds(F.size(word_array(col)) < 0)
    cost = {r.name: max(seconds(_lazy((r,), col).isNotNull()) - least, 1e-4) for r in rules}
    # One row per combination of verdicts: at most 2 to the number of rules.
    marks = features(col)
    flags = [r.rejects(lambda name: F.col("f")[name]).alias(r.name) for r in rules]
    patterns = [
        ({r.name for r in rules if row[r.name]}, row["n"])
        for row in sample.select(marks.alias("f")).groupBy(*flags).agg(F.count("*").alias("n")).collect()
    ]
    order, left = [], list(rules)
    while left:
        gained = {r.name: sum(n for hit, n in patterns if r.name in hit) for r in left}
        best = max(left, key=lambda r: gained[r.name] / cost[r.name])
        order.append({"rule": best, "seconds": cost[best.name], "rejected": gained[best.name]})
        patterns = [(hit, n) for hit, n in patterns if best.name not in hit]
        left.remove(best)
    return order


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, all columns kept."""
    order = tuple(e["rule"] for e in estimates(docs, rules, text))
    return docs.where(_lazy(order, F.col(text)).isNull())


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, features, `base_failed` and `kept` of every document.

    The features are results here, so the cascade only compares them.
    """
    order = [e["rule"] for e in estimates(docs, rules, text)]
    counted = docs.select(F.col(key), features(F.col(text)).alias("f"))

    def feature(name: str) -> Column:
        return F.col("f")[name]

    rejected_by = F.coalesce(*[F.when(r.rejects(feature), F.lit(r.name)) for r in order])
    base = [r.rejects(feature) for r in rules if r.base]
    failed = F.lit(False)
    for rule in base:
        failed = failed | rule
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select(
        key,
        *[feature(n).alias(n) for n in names],
        failed.alias("base_failed"),
        rejected_by.isNull().alias("kept"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i : i + 4] AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT r, unnest(starts) AS i
  FROM (SELECT r, list(i) AS starts FROM g GROUP BY r, gram HAVING count(*) > 1)
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY r
), c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words
            OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 40 * n_words) AS kept
FROM c
"""
