"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks.  Block ``j`` of a source with weight ``w`` may start in slot
``floor(j / w)`` and must be done by ``ceil((j + 1) / w)``; each slot goes to the released
block with the earliest deadline.  At any slot every source that still has rows is less
than one block away from its share.  Weights are exact ratios of whole numbers, nothing is
rounded; a source without rows left takes no slots.

The slots are cut into windows of about ``WINDOW_BLOCKS`` blocks, which tasks work out side
by side.  A window begins from the blocks that are likely done at its first slot: all whose
deadline has passed and, of those under way, as many with the earliest deadlines as the
sources' shares add up to; from there no deadline is missed.  Windows that begin otherwise
than the one before them ended are worked out anew from that end, until all fit: then the
order is the one that a single pass over all slots gives.  Two orders that differ at some
slot are alike again once the blocks they differ in are done, so few windows are repeated.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carecohort.llm.common import running_offsets, shuffle_partitions
from carecohort.storage import written

#: Rows per block; blocks released in a window.
BLOCK_ROWS = 16
WINDOW_BLOCKS = 16_384
#: Sources beyond this number are refused; they are listed on the driver.
MAX_SOURCES = 100_000
#: Default weights: rows of a source to this power.
ALPHA = 0.7


def whole_numerators(weights: Mapping) -> dict:
    """Whole numbers in exactly the ratios of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: w // common for s, w in whole.items()}


class Schedule:
    """Earliest deadline first over any window of slots.  A source's share is its numerator over the sum of all."""

    def __init__(self, numerators: list[int], blocks: list[int]):
        self.numerators, self.blocks, self.total = numerators, blocks, sum(numerators)
        #: All deadlines have passed then.
        self.end = max((self.deadline(i, n - 1) for i, n in enumerate(blocks) if n), default=0)

    def release(self, i: int, j: int) -> int:
        return j * self.total // self.numerators[i]

    def deadline(self, i: int, j: int) -> int:
        return -(-(j + 1) * self.total // self.numerators[i])

    def due(self, slot: int) -> list[int]:
        """Blocks of each source that must be done before ``slot``."""
        return [min(n, slot * w // self.total) for w, n in zip(self.numerators, self.blocks, strict=True)]

    def released(self, slot: int) -> int:
        """Blocks that may start before ``slot``."""
        return sum(min(n, -(-slot * w // self.total)) for w, n in zip(self.numerators, self.blocks, strict=True))

    def border(self, k: int, size: int) -> int:
        """First slot of window ``k``: ``k * size`` blocks are released before it."""
        if k * size >= sum(self.blocks):
            return self.end
        return bisect_left(range(self.end), k * size, key=self.released)

    def likely(self, slot: int) -> list[int]:
        """Blocks of each source that are likely done before ``slot``; no later deadline is missed from there."""
        done, open_, shares = self.due(slot), [], 0
        for i, (w, n) in enumerate(zip(self.numerators, self.blocks, strict=True)):
            if done[i] < n and (part := slot * w % self.total):
                open_.append((self.deadline(i, done[i]), i))
                shares += part
        for _, i in sorted(open_)[: -(-shares // self.total)]:
            done[i] += 1
        return done

    def ahead(self, slot: int, done: list[int]) -> bytes:
        """``done`` as a bit for each source: whether its block under way is done."""
        return np.packbits(np.array(done) > np.array(self.due(slot))).tobytes()

    def done(self, slot: int, ahead: bytes) -> list[int]:
        bits = np.unpackbits(np.frombuffer(ahead, np.uint8), count=len(self.blocks)).tolist()
        return [n + b for n, b in zip(self.due(slot), bits, strict=True)]

    def window(self, start: int, stop: int, done: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, block, release, deadline, slot) of the slots from ``start`` up to ``stop``; moves ``done`` on."""
        waiting = [(self.release(i, j), i) for i, j in enumerate(done) if j < self.blocks[i]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        slot = start
        while waiting or ready:
            if not ready:
                slot = max(slot, waiting[0][0])
            if slot >= stop:
                break
            while waiting and waiting[0][0] <= slot:
                release, i = heapq.heappop(waiting)
                heapq.heappush(ready, (self.deadline(i, done[i]), i, release))
            deadline, i, release = heapq.heappop(ready)
            if deadline <= slot:
                raise AssertionError("a deadline was missed")
            yield i, done[i], release, deadline, slot
            done[i] += 1
            if done[i] < self.blocks[i]:
                heapq.heappush(waiting, (self.release(i, done[i]), i))
            slot += 1


_STATES = "_window bigint, _begins binary, _ends binary"
_PLAN = "_no int, _block bigint, _release bigint, _deadline bigint, _slot bigint, _first bigint"


def _fitting(windows: DataFrame, schedule: Schedule, size: int) -> DataFrame:
    """What is done at the first slot of every window, so that each goes on where the one before it ended."""

    def ends(batches):
        for batch in batches:
            out = []
            for k, begins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, stop = schedule.border(k, size), schedule.border(k + 1, size)
                done = schedule.likely(start) if begins is None else schedule.done(start, begins)
                begins = schedule.ahead(start, done)
                for _ in schedule.window(start, stop, done):
                    pass
                out.append((k, begins, schedule.ahead(stop, done)))
            if out:
                k, begins, after = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(begins, pa.binary()), pa.array(after, pa.binary())],
                    ["_window", "_begins", "_ends"],
                )

    known = written(windows.select("_window", F.lit(None).cast("binary").alias("_begins")).mapInArrow(ends, _STATES), "mix_windows")
    while True:
        before = known.select((F.col("_window") + 1).alias("_window"), F.col("_ends").alias("_wanted"))
        moved = known.join(before, "_window").where("_begins <> _wanted").select("_window", F.col("_wanted").alias("_begins"))
        moved = written(moved, "mix_moved")
        if moved.isEmpty():
            return known.select("_window", "_begins")
        parts = shuffle_partitions(known.sparkSession)
        again = moved.repartition(parts, "_window").mapInArrow(ends, _STATES)
        known = written(known.join(moved, "_window", "left_anti").unionByName(again), "mix_windows")


def _plan(spark: SparkSession, numerators: list[int], rows: list[int], block_rows: int, size: int) -> DataFrame:
    """Release, deadline, slot and place of the first row of every block."""
    schedule = Schedule(numerators, [-(-n // block_rows) for n in rows])
    if schedule.end >= 2**63 - 1:
        raise ValueError("a weight is so small that slots pass 64 bits")
    count = -(-sum(schedule.blocks) // size)
    windows = spark.range(0, count, 1, max(1, min(count, 16 * shuffle_partitions(spark)))).withColumnRenamed("id", "_window")

    def ordered(batches):
        names = ["_no", "_block", "_release", "_deadline", "_slot", "_first"]
        types = [pa.int32()] + [pa.int64()] * 5
        for batch in batches:
            for k, begins in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, stop = schedule.border(k, size), schedule.border(k + 1, size)
                done = schedule.done(start, begins)
                first, out = sum(min(n, j * block_rows) for n, j in zip(rows, done, strict=True)), []
                for i, j, *times in schedule.window(start, stop, done):
                    out.append((i, j, *times, first))
                    first += min(block_rows, rows[i] - j * block_rows)
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return written(_fitting(windows, schedule, size).mapInArrow(ordered, _PLAN), "mix_plan")


def scheduled(docs: DataFrame, weights: Mapping | None = None, block_rows: int = BLOCK_ROWS,
              id_col: str = "doc_id", source_col: str = "source", window_blocks: int = WINDOW_BLOCKS) -> DataFrame:
    """Rows as ``row``, a struct of all columns of ``docs``, and ``mix``: block, release, deadline, slot and position.

    Rows of a source are ordered by a hash of their id.  Sources that ``weights`` does not
    name are refused; without ``weights`` a source weighs its rows to the power 0.7.
    Floats weigh what they hold exactly; fractions and decimals may be given too.
    """
    spark = docs.sparkSession
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.source: r.n for r in counted.limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        weights = {s: n**ALPHA for s, n in counts.items()}
    if missing := [s for s in counts if not 0 < weights.get(s, 0) < math.inf]:
        raise ValueError(f"sources without a weight: {missing[:5]}")
    # names without a positive weight are none of the table's
    names = sorted((s for s in weights if weights[s] > 0), key=lambda s: (s is not None, s))
    whole = whole_numerators({s: weights[s] for s in names}) if names else {}
    plan = _plan(spark, [whole[s] for s in names], [counts.get(s, 0) for s in names], block_rows, window_blocks)
    kind = docs.schema[source_col].dataType.simpleString()
    # bounded by MAX_SOURCES
    shares = spark.createDataFrame([(s, i) for i, s in enumerate(names)], f"_name {kind}, _no int")
    # the caller's columns travel in a struct, where no helper's name can clash with theirs
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("_source"),
        F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_at"),
    )
    rows = rows.join(F.broadcast(shares), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    buckets = shuffle_partitions(spark)
    rows = rows.withColumn("_bucket", F.floor(F.shiftrightunsigned("_at", 1) / F.lit(2.0**63) * buckets))
    totals = rows.groupBy("_no", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = running_offsets(totals, ["_bucket"], "_n", "_before", ["_no"]).drop("_n")
    inside = Window.partitionBy("_no", "_bucket").orderBy("_at", "_id")
    rows = rows.withColumn("_inside", F.row_number().over(inside) - 1).join(before, ["_no", "_bucket"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_inside"))
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("bigint"))
    rows = rows.join(plan, ["_no", "_block"])
    mix = F.struct(
        F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"),
        F.col("_slot").alias("slot"), (F.col("_first") + F.col("_rank") % block_rows).alias("position"),
    )
    return rows.select("row", mix.alias("mix"))


def mixed_positions(docs: DataFrame, weights: Mapping | None = None, block_rows: int = BLOCK_ROWS,
                    id_col: str = "doc_id", source_col: str = "source", window_blocks: int = WINDOW_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, block, release, deadline, slot, position.

    ``position`` numbers all rows from 0 in the order of the mix.  Slots of a source that has
    no rows left stay empty and the other sources move up.  A null source is a source of its
    own; null ids come in hash order like others; rows that repeat an id take their places
    in any order.  Blocks of equal deadline go by source name (null first), then by number.  An
    empty table gives no rows.  Other columns are not read.  ``window_blocks`` changes nothing in the result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    rows = scheduled(named, weights, block_rows, "doc_id", "source", window_blocks)
    return rows.select("row.*", "mix.*")


def in_mixed_order(docs: DataFrame, weights: Mapping | None = None, block_rows: int = BLOCK_ROWS,
                   id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs``, sorted in the order of the mix: written files follow it."""
    rows = scheduled(docs, weights, block_rows, id_col, source_col)
    return (
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "mix.position")
        .sortWithinPartitions("mix.position").select("row.*")
    )
