"""Personal data in texts, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Masking them is not
enough when other words of the text point to the same person, so terms are judged by what the
corpus says: a value found by a pattern is an entity c, a word is a term t, and over all documents

    information of c:  IC(c) = log2(N / df(c))
    disclosed by t:    PMI(c; t) = log2(P(c | t) / P(c)), P(c) = df(c) / N

P(c | t) is the lower end of its Wilson interval at `Z` standard errors, so few documents are weak
evidence: a term seen once, with c, counts as if it led there in 27 % of cases, five such
sightings as 65 %. A rare word isn't removed for being rare; it takes repeated co-occurrence.

A term of a document is removed if it discloses `REMOVE` of the information of an entity of the
same document, generalised from `GENERALISE` on. What is removed for an entity is removed from every
document that contains it, as such a term leads to the entity wherever it stands. Terms are all runs
of letters, marks and digits outside the patterns' spans, of any length; frequent words disclose too
little to be flagged. Text written without spaces isn't segmented: a run is one term. Entities of
every document frequency are judged. Entities that stand in exactly the same documents have the
same counts with every term and are judged as one, so a list of thousands of addresses in one
text is paired with the text's terms once.

Removing leaves nothing; generalising leaves the kind of thing: the decade of a year, the size of
a number, or that a code, a name or a word stood there.

Everything is built from DataFrame functions. Regular expressions are possessive and start only
where a match can, so a text costs time in proportion to its length. Positions come from the
texts between the matches by prefix sums within the row. Co-occurrences are counted with partial
sums before each shuffle, for terms rare enough to reach `GENERALISE` if each of an entity's
documents held them; others can't be flagged. Only the flagged spans of a document are gathered.

Spans count code points, the end exclusive. Defined results: a null or empty text has no spans;
rows that repeat id and text count as one document and get the same spans each; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.small import broadcast_up_to, stored
from waybill.llm.quality_rules import bound

Z = 1.645
GENERALISE, REMOVE = 0.8, 0.95
BROADCAST_ROWS = 1_000_000

# The patterns. \G lets a match start right after the one before it; otherwise one
# starts where its first run of characters does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"[\p{L}\p{M}\p{N}]++"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


#: kind, pattern, a plain hint without which nothing matches, and what a match must pass.
KINDS: tuple[tuple[str, str, str | None, Callable[[Column], Column]], ...] = (
    ("email", EMAIL, "@", lambda found: F.lit(True)),
    ("ip", IP, None, lambda found: found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    (
        "card",
        CARD,
        None,
        lambda found: F.char_length(_digits(found)).between(12, 19) & F.call_function("luhn_check", _digits(found)),
    ),
    ("phone", PHONE, "+", lambda found: F.char_length(_digits(found)).between(9, 15)),
)
BASE = tuple(k for k, *_ in KINDS)
WORDS = "array<struct<start:int,stop:int,term:string>>"
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,entity:bigint>>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Prefix totals of an array under an associative `combine`, by doubling: k log k steps."""

    def of(first: Column) -> Column:
        rounds = F.ceil(F.log2(F.greatest(F.size(first), F.lit(2)).cast("double"))).cast("int")

        def step(total: Column, turn: Column) -> Column:
            shift = F.call_function("shiftleft", F.lit(1), turn)
            return F.transform(
                total, lambda x, i: F.when(i >= shift, combine(F.get(total, i - shift), x)).otherwise(x)
            )

        return F.aggregate(F.sequence(F.lit(0), rounds - 1), first, step)

    return bound(values, of)


def matches(text: Column, pattern: str, body: Callable[[Column, Column], Column], otherwise: Column) -> Column:
    """`body` of the matches of a pattern and their starts; `otherwise` if there are none."""

    def placed(found: Column) -> Column:
        def after(gaps: Column) -> Column:
            moved = F.transform(
                found,
                lambda _, i: F.char_length(F.get(gaps, i))
                + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(F.lit(0)),
            )
            return bound(running(moved, lambda a, b: a + b), lambda starts: body(found, starts))

        return F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), after)).otherwise(otherwise)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """The pattern spans of a text, by start, then kind."""
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    parts = []
    for rank, (kind, pattern, hint, passes) in enumerate(KINDS):

        def spans(found: Column, starts: Column, kind=kind, rank=rank, passes=passes) -> Column:
            def one(value: Column, i: Column) -> Column:
                start = F.get(starts, i)
                return F.struct(
                    start.cast("int").alias("start"),
                    F.lit(rank).alias("rank"),
                    (start + F.char_length(value)).cast("int").alias("stop"),
                    F.when(passes(value), F.lit(kind)).alias("kind"),
                    F.xxhash64(F.lit(kind), F.lower(value)).alias("entity"),
                )

            return F.filter(F.transform(found, one), lambda s: s["kind"].isNotNull()).cast(SPAN)

        part = matches(body, pattern, spans, none)
        parts.append(part if hint is None else F.when(F.contains(body, F.lit(hint)), part).otherwise(none))
    return F.sort_array(F.concat(*parts))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def _terms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def lower_share(hits: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of hits out of n."""
    p, z2 = hits / n, z * z
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (p + z2 / (2 * n) - half) / (1 + z2 / n)


def _judged(total: int, generalise: float, z: float) -> tuple[Callable[..., Column], Callable[[Column], Column]]:
    """Strength of a pair from its counts, and the df up to which a term can reach `generalise`."""

    def strength(both: Column, df: Column, df_term: Column) -> Column:
        share = df / F.lit(float(total))
        return F.log2(lower_share(both, F.greatest(df_term, both), z) / share) / -F.log2(share)

    def rarest(df: Column) -> Column:
        # The lower end is at most df(c, t) / df(t), and that at most df(c) / df(t).
        # A little more, so that rounding loses no term.
        return df * F.pow(df / F.lit(float(total)), F.lit(generalise - 1)) * F.lit(1 + 1e-9)

    return strength, rarest


def disclosing(
    holders: DataFrame, terms: DataFrame, other_texts: DataFrame, total: int, generalise: float, z: float
) -> tuple[DataFrame, DataFrame]:
    """(row, entity, term) that can matter, and (entity, term, strength, df_term, both) from `generalise` on.

    holders: row, entity, df (of the entity); terms: row, term of the documents that hold one;
    other_texts: text of the others. The strength is the share of the entity's information.
    """
    strength, rarest = _judged(total, generalise, z)
    known = broadcast_up_to(stored(terms.select("term").distinct()), BROADCAST_ROWS)
    elsewhere = other_texts.select(F.explode(_terms(F.col("text"))).alias("term")).join(known, "term", "left_semi")
    spread = elsewhere.unionByName(terms.select("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    holders = holders.where(F.col("df") < total)
    top = holders.agg(F.coalesce(F.max(rarest(F.col("df"))), F.lit(0.0))).first()[0]
    rare = broadcast_up_to(stored(spread.where(F.col("df_term") <= top)), BROADCAST_ROWS)
    pairs = holders.join(terms.join(rare, "term"), "row").where(F.col("df_term") <= rarest(F.col("df")))
    pairs = stored(pairs.select("row", "entity", "term", "df", "df_term"))
    both = pairs.groupBy("entity", "term").agg(
        F.count("*").alias("both"), F.first("df").alias("df"), F.first("df_term").alias("df_term")
    )
    judged = both.withColumn("strength", strength(F.col("both"), F.col("df"), F.col("df_term")))
    judged = judged.select("entity", "term", "strength", "df_term", "both")
    return pairs.select("row", "entity", "term"), stored(judged.where(F.col("strength") >= generalise))


def personal_spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    z: float = Z,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """row, id, base, spans of every document; `row` is a digest of id and text."""
    named = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    identity = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("text")))
    named = named.withColumn("row", identity)
    base = stored(named.select("row", "id", base_spans(F.col("text")).alias("base")))
    held = stored(base.where(F.size("base") > 0).select("row", "base").dropDuplicates(["row"]))
    holders = held.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity"))
    # Entities of the same documents are one: told by 128 bits over their rows, and their number.
    halves = [F.expr(f"bit_xor(xxhash64(row, {k}))").cast("string") for k in (1, 2)]
    alike = holders.groupBy("entity").agg(F.count("*").alias("df"), F.md5(F.concat_ws("|", *halves)).alias("alike"))
    holders = stored(holders.join(alike, "entity").select("row", F.col("alike").alias("entity"), "df").distinct())
    nothing = F.array().cast(SPAN)
    if holders.isEmpty():
        return base.select("row", "id", "base", F.col("base").alias("spans"))
    rows = broadcast_up_to(held.select("row"), BROADCAST_ROWS)
    texts = named.join(rows, "row", "left_semi").dropDuplicates(["row"])
    free = F.filter(
        _words(F.col("text")),
        lambda a: ~F.exists("base", lambda b: (b["start"] < a["stop"]) & (a["start"] < b["stop"])),
    )
    words = stored(texts.join(held, "row").select("row", F.inline(free)))
    terms = stored(words.select("row", "term").distinct())
    others = named.join(rows, "row", "left_anti")
    pairs, strong = disclosing(holders, terms, others, base.count(), generalise, z)
    strong = broadcast_up_to(strong, BROADCAST_ROWS)
    marked = pairs.join(strong, ["entity", "term"]).select("row", "term", "strength")
    wide = strong.where((F.col("strength") >= remove) & (F.col("df_term") > F.col("both")))
    wide = stored(wide.groupBy("term").agg(F.max("strength").alias("strength")))
    if not wide.isEmpty():
        wide = broadcast_up_to(wide, BROADCAST_ROWS)
        marked = marked.unionByName(terms.join(wide, "term").select("row", "term", "strength"))
        having = others.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(wide, "term")
        having = stored(having.select("row", "term", "strength").distinct())
        marked = marked.unionByName(having)
        more = broadcast_up_to(stored(having.select("row").distinct()), BROADCAST_ROWS)
        more = others.join(more, "row", "left_semi").dropDuplicates(["row"])
        words = words.unionByName(more.select("row", F.inline(_words(F.col("text")))))
    marked = marked.groupBy("row", "term").agg(F.max("strength").alias("strength"))
    gone = F.col("strength") >= remove
    ranks = (F.when(gone, F.lit(len(BASE) + 1)).otherwise(F.lit(len(BASE))), F.when(gone, F.lit("remove")).otherwise(F.lit("generalise")))
    added = F.struct("start", ranks[0].alias("rank"), "stop", ranks[1].alias("kind"), F.lit(0).cast("long").alias("entity"))
    found = words.join(marked, ["row", "term"]).groupBy("row").agg(F.collect_list(added).cast(SPAN).alias("added"))
    return base.join(found, "row", "left").select(
        "row", "id", "base", F.sort_array(F.concat("base", F.coalesce("added", nothing))).alias("spans")
    )


def _words(text: Column) -> Column:
    """Every word of a text: start, stop, term."""

    def spans(found: Column, starts: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            start = F.get(starts, i)
            return F.struct(
                start.cast("int").alias("start"),
                (start + F.char_length(value)).cast("int").alias("stop"),
                F.lower(value).alias("term"),
            )

        return F.transform(found, one).cast(WORDS)

    return matches(text, TERM, spans, F.array().cast(WORDS))


def generalised(term: Column) -> Column:
    """What kind of thing a term is: a decade, a number of some size, a code, a name or a word."""
    digits = F.char_length(term)
    low, high = F.rpad(F.lit("1"), digits, F.lit("0")), F.repeat(F.lit("9"), digits)
    return (
        F.when(term.rlike(r"^(?:18|19|20)[0-9]{2}$"), F.concat(F.lit("["), F.substring(term, 1, 3), F.lit("0s]")))
        .when(term.rlike(r"^[0-9]$"), F.lit("[0-9]"))
        .when(term.rlike(r"^[0-9]+$"), F.concat(F.lit("["), low, F.lit("-"), high, F.lit("]")))
        .when(term.rlike(r"\p{N}"), F.lit("[CODE]"))
        .when(term.rlike(r"^\p{Lu}"), F.lit("[NAME]"))
        .otherwise(F.lit("[WORD]"))
    )


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns; personal data named by kind, disclosing terms generalised or removed."""
    spans = personal_spans(docs, key, text, **options).select("row", "spans").dropDuplicates(["row"])
    spans = stored(spans.where(F.size("spans") > 0))
    body = F.coalesce(F.col(text), F.lit(""))
    identity = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("-")), body))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), body.alias("_text"), identity.alias("row"))
    joined = whole.join(broadcast_up_to(spans, BROADCAST_ROWS // 10), "row", "left")
    mask = F.create_map(*[F.lit(x) for k in BASE for x in (k, f"[{k.upper()}]")], F.lit("remove"), F.lit(""))

    def rebuilt(found: Column) -> Column:
        ends = running(F.transform(found, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))

        def pieces(upto: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(upto, i - 1)).otherwise(F.lit(0))
                kept = F.substring(F.col("_text"), before + 1, F.greatest(s["start"] - before, F.lit(0)))
                # A span inside earlier ones adds nothing.
                own = F.substring(F.col("_text"), s["start"] + 1, s["stop"] - s["start"])
                shown = F.when(s["kind"] == "generalise", generalised(own)).otherwise(F.try_element_at(mask, s["kind"]))
                return F.concat(kept, F.when(s["stop"] > before, shown).otherwise(F.lit("")))

            tail = F.substring(F.col("_text"), F.element_at(upto, -1) + 1, F.char_length("_text"))
            return F.concat(F.array_join(F.transform(found, one), ""), tail)

        return bound(ends, pieces)

    new = F.when(F.col("spans").isNull(), F.col("_doc")[text]).otherwise(rebuilt(F.col("spans")))
    return joined.select(*[(new if c == text else F.col("_doc")[c]).alias(c) for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[counted(k) for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
