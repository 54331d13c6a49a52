"""WARC archives of pages, and their global index by merging local runs.

Writing: records are sorted by URL key and capture time inside each task, without a shuffle, and
written as archives by Spark's text writer, whose line separator is the blank lines that end a
record. Each archive is one locally sorted capture run. Payloads of `REVISIT_BYTES` or more that
are equal are written once, with the record of the largest page id; the others revisit it.

Reading: tasks parse whole archives into index entries, in the order of the run. The entries, not
the payloads, are dealt by ranges of (URL key, time, id), so one URL captured very often spreads
over ranges. In a range the runs meet as sorted lists and a loser tree merges them: each step
replays one path of the tree, log2(runs) comparisons. The ranges in order are the global history.
There are as many ranges as keep each to about `RANGE_ENTRIES` entries, whatever the table's size.

Each entry's place in the history of its URL key, `history_no`, is counted while merging. A key that
runs over several ranges is counted in each; what the ranges before hold of it (a row per range and
key that reaches a range's end) is added afterwards, so a hot key meets in no task.

Defined results: a null html is an empty payload, a null URL an empty one, a null id is absent;
rows that repeat the largest id of equal payloads are all responses; among null ids only, too. A
page has no capture time of its own: it is taken `page_id` seconds, modulo a billion, after 2000 began.
An empty table gives an empty archive and an empty index.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waybill.functions.small import broadcast_up_to, fresh_path, stored
from waybill.llm.words import bounded_batches

REVISIT_BYTES = 1000
#: Records of an archive: many small ones, or a few whose payload is larger than `SMALL_BYTES`.
SMALL_BYTES, SMALL_RECORDS, LARGE_RECORDS = 1 << 16, 1000, 16
BROADCAST_ROWS = 1_000_000
RANGE_ENTRIES = 100_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = (
    "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, intact boolean, archive string, entry_no long, record_start long, record_bytes long"
)


def url_key(url: Column) -> Column:
    """Host names reversed and comma-joined, then the path: hosts of a domain sort together."""
    clean = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    rest = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]*(:[0-9]*)?", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _target(url: Column) -> Column:
    """Characters that would end a header line are written as in a URL."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")


def _second(page_id: Column) -> Column:
    return F.lit(946684800) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))


def _record(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column) -> Column:
    """Text of a record, without the blank lines that end it."""
    revisit = refers_to.isNotNull()
    size = F.octet_length(html).cast("string")
    target = _target(url)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(html))
    date = F.date_format(F.timestamp_seconds(_second(page_id)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _urn(page_id)),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Refers-To: "), _urn(refers_to)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out the lines that are null.
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes page_id, url, html as archives of locally sorted runs below `path`."""
    html = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    named = named.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    facts = stored(named.select("page_id", "bytes", "digest"))
    equal = facts.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
    first = equal.agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = broadcast_up_to(stored(first), BROADCAST_ROWS)
    joined = named.join(first, ["digest", "bytes"], "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(other, F.col("first"))
    records = joined.select(
        "bytes",
        url_key(_target(F.col("url"))).alias("key"),
        _second(F.col("page_id")).alias("second"),
        "page_id",
        _record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), refers).alias("value"),
    ).sortWithinPartitions("key", "second", "page_id")
    most = facts.agg(F.max("bytes")).first()[0] or 0
    kinds = [("small", F.col("bytes") <= SMALL_BYTES, SMALL_RECORDS)]
    if most > SMALL_BYTES:
        kinds.append(("large", F.col("bytes") > SMALL_BYTES, LARGE_RECORDS))
    for name, which, records_each in kinds:
        writer = records.where(which).select("value").write.option("lineSep", END)
        writer.option("maxRecordsPerFile", records_each).option("compression", compression).text(f"{path}/{name}")


def _unpacked(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(wbits=31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in lines.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def _number(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def entries(archive: str, content: bytes) -> Iterator[dict]:
    """Index entries of an archive, in its order."""
    data, at, number, end = _unpacked(content), 0, 0, END.encode()
    while at < len(data):
        start, body = at, data.index(end, at) + 4
        head = _headers(data[at : body - 4])
        stop = body + int(head["content-length"])
        if data[stop : stop + 4] != end:
            raise ValueError(f"{archive}: the record at {start} isn't as long as it says")
        content_at = data.index(end, body) + 4
        http = _headers(data[body : content_at - 4])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        payload = data[content_at:stop]
        response = head["warc-type"] == "response"
        found = hashlib.sha1(payload).hexdigest() if response else digest
        yield {
            "target": head["warc-target-uri"],
            "captured": head["warc-date"],
            "page_id": _number(head.get("warc-record-id")),
            "payload_bytes": len(payload) if response else int(http["content-length"]),
            "payload_digest": found,
            "record_type": head["warc-type"],
            "refers_to": _number(head.get("warc-refers-to")),
            "intact": found == digest,
            "archive": archive,
            "entry_no": number,
            "record_start": start,
            "record_bytes": stop - start,
        }
        at, number = stop + 4, number + 1


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below `path`; entry_no gives the order in a run."""
    schema = pa.schema(
        [("target", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64())]
        + [("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
        + [("archive", pa.string()), ("entry_no", pa.int64()), ("record_start", pa.int64()), ("record_bytes", pa.int64())]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist(list(entries(archive, content.as_py())), schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    parsed = bounded_batches(files).mapInArrow(parse, ENTRY.replace("url_key", "target"))
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]
    return parsed.withColumn("url_key", url_key(F.col("target"))).select(*names)


class LoserTree:
    """Merges sorted runs; an inner node keeps the loser of its match, the winner plays on."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for run in range(len(runs)):
            self._play(run)

    def _head(self, run: int) -> tuple | None:
        at = self.at[run]
        return self.runs[run][at] if at < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        """A finished run loses to any other; equal heads go to the earlier run."""
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        """Plays a run from its leaf to the root, or to the first place that waits for a match."""
        node = (run + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of the entries in order."""
        while self.runs:
            run = self.losers[0]
            if self._head(run) is None:
                return
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a range; rows come by run, in its order."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    keys = zip(
        table["url_key"].to_pylist(),
        table["captured"].to_pylist(),
        [-(1 << 63) - 1 if x is None else x for x in table["page_id"].to_pylist()],
        strict=True,
    )
    runs, starts, count = [], [], 0
    for _, run in groupby(zip(table["archive"].to_pylist(), keys, strict=True), key=lambda x: x[0]):
        runs.append([key for _, key in run])
        starts.append(count)
        count += len(runs[-1])
    order, places, before, key_start = [], [], None, 0
    for run, at in LoserTree(runs):
        key = runs[run][at]
        if before is None or key[0] != before[0]:
            key_start = len(order)
        # Equal captures share a place.
        places.append(places[-1] if key == before else len(order) - key_start + 1)
        order.append(starts[run] + at)
        before = key
    merged = table.take(pa.array(order)).append_column("history_no", pa.array(places, pa.int64()))
    yield from merged.combine_chunks().to_batches()


def merged_index(runs: DataFrame) -> DataFrame:
    """All entries in the order of (URL key, time, id), over the partitions and within each.

    history_no is an entry's rank in its URL key's history, from 1; equal (time, id) share it.
    runs: stored.
    """
    ranges = max(1, -(-runs.count() // RANGE_ENTRIES))
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("archive", "entry_no")
    shape = StructType([*ranged.schema.fields, StructField("history_no", LongType())])
    merged = ranged.mapInArrow(_some(_merged, ranged.schema), shape)
    if ranges == 1:
        return merged
    merged = stored(merged.withColumn("_range", F.spark_partition_id()))
    counts = merged.groupBy("_range").agg(F.min("url_key").alias("low"), F.max("url_key").alias("high"))
    # Only a range's first key can go on from earlier ranges, and there it is the last key.
    ends = merged.join(counts.select("_range", F.col("high").alias("url_key")), ["_range", "url_key"])
    ends = ends.groupBy("_range", "url_key").agg(F.count("*").alias("held"))
    opens = counts.select("_range", F.col("low").alias("url_key"), F.lit(0).cast("long").alias("held"))
    ends = ends.unionByName(opens).groupBy("_range", "url_key").agg(F.sum("held").alias("held"))
    before = Window.partitionBy("url_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select("_range", "url_key", F.sum("held").over(before).alias("_earlier")).where("_earlier > 0")
    placed = merged.join(broadcast_up_to(stored(earlier), BROADCAST_ROWS), ["_range", "url_key"], "left")
    at = F.col("history_no") + F.coalesce("_earlier", F.lit(0))
    return placed.withColumn("history_no", at).select(*shape.names)


def _some(merge, schema):
    """A task without rows gets no batch at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            yield from merge(batches)

    return run


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as archives, below `path` or in the shared folder, and returns the global index."""
    spark = pages.sparkSession
    path = path or f"{fresh_path(spark)}"
    write_archives(pages, path)
    return merged_index(stored(read_runs(spark, path)))


def op9(spark, sf_dir: str) -> DataFrame:
    index = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_no"
    )


OP9_SQL = rf"""
WITH c AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target,
    make_timestamp((946684800 + ((coalesce(page_id, 0) % 1000000000) + 1000000000) % 1000000000) * 1000000) AS moment
  FROM pages
), p AS (
  SELECT *, array_to_string(list_reverse(string_split(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)), '.')), ',')
      || ')' || regexp_replace(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]*(:[0-9]*)?', '') AS url_key,
    strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM c
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first,
    rank() OVER (PARTITION BY url_key ORDER BY moment, page_id NULLS FIRST) AS history_no FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to,
       url_key, captured, history_no
FROM f
"""
