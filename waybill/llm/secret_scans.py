"""Secrets in texts: fixed patterns, and strings of high entropy.

Candidates are the maximal runs of token characters of `WINDOW` or more. In each, a window slides
over the stretches of every character class; the counts in the window change by one character in
and one out, so each step costs the same whatever the window's length. Windows whose Shannon
entropy reaches the class's threshold are flagged and merged. The allow-list suppresses flagged
spans, not runs: numbers, names, words with a number and slugs; UUIDs and alphabets are cut out and
what stands around them is scanned. Spans a pattern already reports add nothing.

Spans count code points, the end exclusive, sorted by start, then kind. Defined results: a null
or empty text has no spans; rows are scanned one by one, so repeats give repeats; other columns
pass through. A long text costs time in proportion to its length.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.words import bounded_batches

WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = KINDS[:3]
#: Bits per character from which a window is flagged, by class of characters: the level that 99 of
#: 100 random keys of `WINDOW` characters of the class reach, and for what words reach as well, more.
CLASSES = {
    "hex": (re.compile(r"[0-9a-f]{%d,}" % WINDOW), 2.85),
    "HEX": (re.compile(r"[0-9A-F]{%d,}" % WINDOW), 2.85),
    "lower_digits": (re.compile(r"[0-9a-z]{%d,}" % WINDOW), 3.4),
    "upper_digits": (re.compile(r"[0-9A-Z]{%d,}" % WINDOW), 3.4),
    "word": (re.compile(r"[a-z]{%d,}|[A-Z]{%d,}" % (WINDOW, WINDOW)), 3.75),
    "letters": (re.compile(r"[A-Za-z]{%d,}" % WINDOW), 3.55),
    "base62": (re.compile(r"[0-9A-Za-z]{%d,}" % WINDOW), 3.65),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), 3.85),
}
#: What a flagged span of a class has to hold; a class without an entry takes any.
HOLDS = {
    "hex": (r"[0-9]", r"[a-f]"),
    "HEX": (r"[0-9]", r"[A-F]"),
    "lower_digits": (r"[0-9].*[0-9]", r"[a-z]"),
    "upper_digits": (r"[0-9].*[0-9]", r"[A-Z]"),
    "letters": (r"[a-z]", r"[A-Z]"),
    "base62": (r"[0-9]", r"[a-z]", r"[A-Z]"),
}
HOLDS = {name: tuple(map(re.compile, parts)) for name, parts in HOLDS.items()}
_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
#: Spans that are no secrets: numbers, names in camel case, a word with a number, slugs of words and numbers.
ALLOWED = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[a-z]*(?:[A-Z][a-z]{2,}|(?:As|At|By|Do|Id|In|Is|It|No|Of|On|Or|To|Up)(?![a-z]))+"),
    re.compile(r"[A-Za-z][a-z]+[0-9]+|[A-Z]+[0-9]+|[0-9]+(?:[A-Z]?[a-z]+|[A-Z]+)"),
    re.compile(rf"[+/_=-]*{_WORD}(?:[+/_=-]+{_WORD})+[+/_=-]*"),
)
#: Stretches that are skipped while what stands around them is scanned: UUIDs and alphabets.
_UUID = r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
)
_SKIPPED = re.compile("|".join([_UUID, *sorted(ALPHABETS, key=len, reverse=True)]))


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + (
    _either_case("api") + "_?" + _either_case("key")
)
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HINTS = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

# c * log2(c) in steps of 2**-40: sums of integers don't drift however far a window slides.
_SCALE = 1 << 40
_TERM = [0, *(round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1))]


def entropy_spans(text: str, least_bits: float) -> Iterator[tuple[int, int]]:
    """Merged windows of `text` whose entropy is at least `least_bits`."""
    # entropy = log2(W) - sum(c log2 c) / W, so the sum may be this much at most.
    most = round((math.log2(WINDOW) - least_bits) * WINDOW * _SCALE)
    counts: dict[str, int] = {}
    total, start, end = 0, -1, -1
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        total += _TERM[c + 1] - _TERM[c]
        counts[char] = c + 1
        if i >= WINDOW - 1:
            if total <= most:
                if i - WINDOW + 1 > end:
                    if end >= 0:
                        yield start, end
                    start = i - WINDOW + 1
                end = i + 1
            gone = text[i - WINDOW + 1]
            c = counts[gone]
            total += _TERM[c - 1] - _TERM[c]
            counts[gone] = c - 1
    if end >= 0:
        yield start, end


def _random_spans(run: str) -> Iterator[tuple[int, int]]:
    """Spans of a candidate run that look random, for some class of characters."""
    at = 0
    for skipped in [*_SKIPPED.finditer(run), None]:
        piece = run[at : skipped.start() if skipped else len(run)]
        if len(piece) >= WINDOW:
            for name, (pattern, bits) in CLASSES.items():
                for m in pattern.finditer(piece):
                    for start, end in entropy_spans(m.group(), bits):
                        found = m.group()[start:end]
                        holds = all(p.search(found) for p in HOLDS.get(name, ()))
                        if holds and not any(p.fullmatch(found) for p in ALLOWED):
                            yield at + m.start() + start, at + m.start() + end
        at = skipped.end() if skipped else at


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret of a text."""
    if not text:
        return []
    base: list[tuple[int, int, str]] = []
    high: list[tuple[int, int]] = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    for found in _CANDIDATE.finditer(text):
        run, at = found.group(), found.start()
        base += [
            (at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(run) if m.end() - m.start() >= 20
        ]
        base += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(run)]
        high += [(at + s, at + e) for s, e in _random_spans(run)]
    known = _merged([(s, e) for s, e, _ in base])

    def reported(start: int, end: int) -> bool:
        i = bisect.bisect_right(known, (start, len(text))) - 1
        return i >= 0 and end <= known[i][1]

    base += [(s, e, "entropy") for s, e in _merged(high) if not reported(s, e)]
    return sorted(base, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _masked(text: str | None, spans: list[tuple[int, int, str]], mask: str) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end in _merged([(s, e) for s, e, _ in spans]):
        parts += [text[at:start], mask]
        at = end
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for s, e, k in scan(t)] for t in texts], dtype=object)


def masked_text(text: Column, mask: str = "[SECRET]") -> Column:
    """The text with every secret, overlapping ones together, replaced by `mask`."""

    @F.pandas_udf(T.StringType())
    def masking(texts: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, scan(t), mask) for t in texts], dtype=object)

    return masking(text)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    parts = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(parts, ",")


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, secrets masked; the length column is brought up to date."""
    out = bounded_batches(docs).withColumn(text, masked_text(F.col(text)))
    return out.withColumn(length, F.char_length(F.col(text)).cast("long")) if length in docs.columns else out


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = bounded_batches(docs).select("doc_id", secret_spans("text").alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def counted(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(k) for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("found")).alias("spans"),
    )
