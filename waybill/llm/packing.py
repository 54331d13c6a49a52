"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces (whole documents, or what is left of one after cutting off sequences of the largest
length) are taken from the longest to the shortest. A piece goes to the open bin, of whatever
length, that it leaves the least room in. If no bin has room, one is opened: each permitted length
is filled on trial with the pieces still to place, and the cheapest per token filled is taken. When
all pieces are placed, every bin shrinks to the smallest permitted length that holds its contents.
A block is also packed by the cost per token of full bins, and the cheaper packing stays.

Blocks of pieces are packed independently, one task each: a block is a digest range of
(id, length), so it doesn't depend on the partitioning. Where rows repeat so often that a block
would be too large, it is dealt further by a row number that is stored first.

Defined results: a document without tokens (null or blank text, null length) gives one row with
no bin; repeated rows are packed each; an empty table gives an empty table. Nothing is dropped:
the pieces of a document cover it exactly once.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.small import broadcast_up_to, stored
from waybill.llm.words import word_array

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces of a block; waste from closing a block is spread over so many.
BLOCK_PIECES = 20_000
BROADCAST_ROWS = 200_000
PACKED = "doc_id long, row long, piece long, token_start long, n_tokens long, bin_id string, capacity long, bin_offset long"


def attention_cost(capacity: int) -> int:
    """Cost of a sequence: linear layers, attention, and a fixed part for starting one."""
    return 4096 * capacity + capacity * capacity + (1 << 18)


def opened(piece: int, left: int, capacities: tuple[int, ...], cost: Callable[[int], int]) -> int:
    """The permitted length for a new bin: least cost per token it can come to hold, then shortest.

    left: tokens that the block has still to place, the piece included.
    """
    fitting = [c for c in capacities if c >= piece]
    best = fitting[0]
    for c in fitting[1:]:
        if cost(c) * min(best, left) < cost(best) * min(c, left):
            best = c
    return best


class Remaining:
    """The pieces still to place, by length, and what a bin could hold of them."""

    def __init__(self, lengths: list[int]):
        self.counts = Counter(lengths)
        self.mask = sum(1 << n for n in self.counts)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.mask &= ~(1 << length)

    def fill(self, capacity: int) -> int:
        """Tokens of a bin filled from the longest piece that fits to the shortest."""
        room, below = capacity, capacity
        while fitting := self.mask & ((1 << (min(room, below) + 1)) - 1):
            length = fitting.bit_length() - 1
            room -= length * min(self.counts[length], room // length)
            below = length - 1
        return capacity - room


def opened_by_fill(piece: int, remaining: Remaining, capacities: tuple[int, ...], cost: Callable[[int], int]) -> int:
    """The permitted length for a new bin: least cost per token it would be filled with, then shortest."""
    fitting = [c for c in capacities if c >= piece]
    best, held = fitting[0], remaining.fill(fitting[0])
    for c in fitting[1:]:
        more = remaining.fill(c)
        if cost(c) * held < cost(best) * more:
            best, held = c, more
    return best


def pack(
    lengths: list[int],
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], int] = attention_cost,
    by_fill: bool = False,
) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each piece and the final length of each bin; pieces in decreasing order.

    by_fill: new bins are opened by `opened_by_fill`, otherwise by `opened`.

    Rooms are kept in a bit mask, so the tightest fit is the lowest set bit at or above a piece;
    of equally tight bins the oldest is taken.
    """
    capacities = tuple(sorted(capacities))
    rooms: list[deque[int]] = [deque() for _ in range(capacities[-1] + 1)]
    mask, used, places = 0, [], []
    left = sum(lengths)
    remaining = Remaining(lengths) if by_fill else None
    for length in lengths:
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            target = rooms[room].popleft()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            if remaining is None:
                room = opened(length, left, capacities, cost)
            else:
                room = opened_by_fill(length, remaining, capacities, cost)
            target = len(used)
            used.append(0)
        places.append((target, used[target]))
        used[target] += length
        left -= length
        if remaining is not None:
            remaining.take(length)
        if room > length:
            rooms[room - length].append(target)
            mask |= 1 << (room - length)
    return places, [next(c for c in capacities if c >= u) for u in used]


def cheapest(
    lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], int] = attention_cost
) -> tuple[list[tuple[int, int]], list[int]]:
    """The cheaper of the packings by either rule for new bins."""
    both = [pack(lengths, capacities, cost, by_fill) for by_fill in (True, False)]
    return min(both, key=lambda packed: sum(map(cost, packed[1])))


def _packer(capacities: tuple[int, ...]):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n_tokens", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        places, final = cheapest(block["n_tokens"].tolist(), capacities)
        name = f"{block['block'].iloc[0]}-{block['part'].iloc[0]}"
        return block.assign(
            bin_id=[f"{name}-{b}" for b, _ in places],
            capacity=[final[b] for b, _ in places],
            bin_offset=[o for _, o in places],
        )[["doc_id", "row", "piece", "token_start", "n_tokens", "bin_id", "capacity", "bin_offset"]]

    return run


def packed(
    docs: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    key: str = "doc_id",
    length: Column | None = None,
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, token_start, n_tokens, bin_id, capacity, bin_offset.

    length: tokens of a row; the words of `text` by default.
    """
    most = max(capacities)
    tokens = F.size(word_array(F.col("text"))) if length is None else length
    items = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("tokens"),
    )
    # The row number is stored, so a task that runs again finds the same one.
    items = stored(items.withColumn("row", F.monotonically_increasing_id()))
    whole = F.expr(f"tokens div {most}")
    tail = F.col("tokens") % most
    none = F.lit(None)
    full = items.where(whole > 0).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select(
        "doc_id",
        "row",
        "piece",
        (F.col("piece") * most).alias("token_start"),
        F.lit(most).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("bin_id"),
        F.lit(most).cast("long").alias("capacity"),
        F.lit(0).cast("long").alias("bin_offset"),
    )
    empty = items.where("tokens = 0").select(
        "doc_id",
        "row",
        *[F.lit(0).cast("long").alias(n) for n in ("piece", "token_start", "n_tokens")],
        none.cast("string").alias("bin_id"),
        *[none.cast("long").alias(n) for n in ("capacity", "bin_offset")],
    )
    tails = items.where(tail > 0).select(
        "doc_id", "row", whole.alias("piece"), (whole * most).alias("token_start"), tail.alias("n_tokens")
    )
    blocks = max(1, math.ceil(tails.count() / block_pieces))
    tails = tails.withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(blocks)))
    sizes = tails.groupBy("block").agg(F.count("*").alias("pieces"))
    parts = stored(sizes.select("block", F.ceil(F.col("pieces") / F.lit(2 * block_pieces)).alias("parts")))
    dealt = tails.join(broadcast_up_to(parts, BROADCAST_ROWS), "block")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    placed = dealt.groupBy("block", "part").applyInPandas(_packer(tuple(capacities)), PACKED)
    return placed.unionByName(full).unionByName(empty).drop("row")


def op1(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
