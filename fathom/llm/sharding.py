"""Sharding: the minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that is never split; groups keep the order of their smallest key.
The smallest shard capacity for which the groups fit into the shards, filled greedily in order, is
found by binary search. Within that capacity the groups are cut where shards come out most even.

How it scales. A greedy check asks for the last group end at or before a number of bytes, once a shard.
The driver answers that from a summary of the prefix sums: the first and last group end in each of a
fixed number of cells. Where a cell can't tell, a check has a lower and an upper answer; the search
narrows the capacity with both, and the cells it still asks for are divided further in the next round,
until lower and upper agree. So the capacity is exact, the rounds grow with the logarithm of the
bytes, and what the driver holds is bounded. Prefix sums are made within range partitions, from
offsets of as many rows as there are partitions. A group of a third of all rows costs one row in the
group table and many range partitions in the table of documents, which are ordered by (group, doc_id).

Defined cases. A null text has no bytes, is a group with other null texts, and its CRC is that of no
bytes; empty texts are another group. Repeated rows are rows of one group. A null doc_id comes first.
An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written
from .graph import spread_join

CELLS = 1 << 14


def _running(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """df ordered over range partitions, with the sum of ``amount`` up to and with each row."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in ranged.groupBy("__part").agg(F.sum(amount)).collect()}
    offsets, total = {}, 0
    for p in sorted(sums):
        offsets[p], total = total, total + sums[p]
    names = [c for c in ranged.columns if c != "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            if before is None:
                before = offsets[b.column("__part")[0].as_py()]
            upto = before + np.cumsum(b.column(amount).to_numpy())
            before = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(upto, pa.int64())], names=[*names, out])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema if f.name != "__part"), f"{out} long"])
    return ranged.mapInArrow(run, schema)


class Ends:
    """What is known of the set of group ends: sorted intervals (first end, last end), others between unknown."""

    def __init__(self, cells: list[tuple[int, int]]) -> None:
        self.first = [a for a, _ in cells]
        self.last = [b for _, b in cells]

    def at_most(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the largest end at most x (0 if none), and the interval that hides it, if they differ."""
        k = bisect_right(self.first, x) - 1
        if k < 0:
            return 0, 0, None
        if x >= self.last[k]:
            return self.last[k], self.last[k], None
        return self.first[k], min(x, self.last[k] - 1), k

    def cuts(self, capacity: int, shards: int, total: int, upper: bool) -> list[int] | None:
        """Greedy cuts, or None if the shards don't hold all."""
        out, at = [], 0
        for _ in range(shards):
            low, high, _ = self.at_most(at + capacity)
            to = max(at, high if upper else low)
            out.append(to)
            at = to
            if at >= total:
                return out + [total] * (shards - len(out))
        return None


def minimax_cuts(groups: DataFrame, shards: int, cells: int = CELLS, capacity: int | None = None) -> tuple[int, list[int]]:
    """The smallest capacity (or one given that fits) and the greedy ends of the shards, from groups (size long, upto long: the prefix sum with the group). The last shards may be empty."""
    total, largest = groups.agg(F.max("upto"), F.max("size")).first()
    if total is None:
        return 0, [0] * shards
    low, high = max(largest, -(-total // shards)) - 1, total  # low never fits, high always does
    if capacity is not None:
        low, high = capacity - 1, capacity
    # The bounds of a cut lie as many cells apart as shards stand before it; so many cells make every round narrower.
    cells = max(cells, 8 * shards * shards)
    asked, before = [(0, total)], 2 * total
    known: list[tuple[int, int]] = []
    while True:
        # Each interval asked for is divided into cells of one width, as many cells in all as the driver holds.
        span = sum(b - a for a, b in asked)
        if span >= before:
            raise RuntimeError("the search for the capacity does not get narrower")
        before = span
        width = max(1, -(-span // cells))
        inside = F.lit(False)
        for a, b in asked:
            inside = inside | ((F.col("upto") > a) & (F.col("upto") <= b))
        base = F.lit(None).cast("long")
        for k, (a, b) in enumerate(asked):
            base = F.when((F.col("upto") > a) & (F.col("upto") <= b), F.lit(k * 2 * cells) + F.floor((F.col("upto") - a - 1) / F.lit(width)).cast("long")).otherwise(base)
        found = groups.where(inside).groupBy(base.alias("cell")).agg(F.min("upto").alias("a"), F.max("upto").alias("b")).collect()
        fresh = [(r.a, r.b) for r in found]
        keep = [c for c in known if not any(a < c[0] <= b for a, b in asked)]
        known = sorted(keep + fresh)
        ends = Ends(known)
        # The smallest capacity that surely fits, and the largest that surely doesn't.
        high = _first(low, high, lambda c: ends.cuts(c, shards, total, upper=False) is not None)
        low = low if high - low == 1 else _first(low, high, lambda c: ends.cuts(c, shards, total, upper=True) is not None) - 1
        hidden: set[int] = set()
        # Cells that a check between the two can ask for: from the lower answers at low + 1 to the upper ones at high.
        for lower, upper in _spans(ends, low + 1, high, shards, total):
            for k in range(max(0, bisect_right(ends.first, lower) - 1), bisect_right(ends.first, upper)):
                if ends.first[k] < ends.last[k]:
                    hidden.add(k)
        if high - low <= 1:
            cuts = ends.cuts(high, shards, total, upper=False)
            if cuts is not None and cuts == ends.cuts(high, shards, total, upper=True):
                return high, cuts
        asked = _merged([(ends.first[k], ends.last[k]) for k in sorted(hidden)])


def _first(low: int, high: int, holds) -> int:
    """The smallest number above low for which it holds, as it does for high."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def _spans(ends: Ends, low: int, high: int, shards: int, total: int) -> Iterator[tuple[int, int]]:
    a = b = 0
    for _ in range(shards):
        lower, upper = a + low, b + high
        yield lower, upper
        a, b = max(a, ends.at_most(lower)[0]), max(b, ends.at_most(upper)[1])
        if a >= total:
            return


def _merged(spans: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` intervals that cover the spans (open at the left)."""
    spans = [(a - 1, b) for a, b in spans]
    out: list[tuple[int, int]] = []
    gaps = sorted((spans[i + 1][0] - spans[i][1] for i in range(len(spans) - 1)), reverse=True)[: most - 1]
    least = gaps[-1] if len(gaps) == most - 1 else 1
    for a, b in spans:
        if out and (a - out[-1][1] < least or a <= out[-1][1]):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def even_cuts(groups: DataFrame, shards: int, cells: int = CELLS) -> list[int]:
    """Ends of the shards, none beyond the smallest capacity, each the nearest to an even share that this allows.

    Filled greedily from the front every end is the latest possible, from the back the earliest; between
    the two lie the ends that leave room for what follows.
    """
    capacity, latest = minimax_cuts(groups, shards, cells)
    total = latest[-1]
    if not total:
        return latest
    mirrored = groups.select("size", (F.lit(total) - F.col("upto") + F.col("size")).alias("upto"))
    earliest = [total - c for c in minimax_cuts(mirrored, shards, cells, capacity)[1][-2::-1]]
    cell = F.expr(f"(upto * {shards} + {total - 1}) div {total}")  # of the first even share that holds the end
    found = {r.cell: (r.a, r.b) for r in groups.groupBy(cell.alias("cell")).agg(F.min("upto").alias("a"), F.max("upto").alias("b")).collect()}
    cuts, at = [], 0
    for j in range(1, shards):
        below = max((b for c, (_, b) in found.items() if c <= j), default=0)
        above = min((a for c, (a, _) in found.items() if c > j), default=total)
        least, most = max(earliest[j - 1], at), min(latest[j - 1], at + capacity)
        fit = [c for c in (below, above, earliest[j - 1], latest[j - 1]) if least <= c <= most]
        if least < below and below > most:  # the last end within reach is none of these
            fit.append(groups.where(F.col("upto") <= most).agg(F.max("upto")).first()[0])
        at = min(fit, key=lambda c: (abs(c * shards - total * j), c))
        cuts.append(at)
    return [*cuts, total]


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; shards are filled nearly equally by bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("key"))
    rows = written(rows, "sizes")
    first = F.coalesce("doc_id", F.lit(-(2**63)))
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    # Groups of one smallest doc_id (a doc_id that repeats with other texts) are told apart by their keys.
    running = written(_running(groups.select("first", "key", "size", "n"), ["first", "key"], "size", "upto"), "running")
    cuts = even_cuts(running, shards)
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("upto") > c).cast("int")
    places = written(running.select("key", F.col("upto").alias("place"), shard.alias("shard"), "n"), "places")
    placed = spread_join(rows.withColumn("tie", F.monotonically_increasing_id()), places, "key", F.xxhash64("tie")).select("doc_id", "tie", "size", "text_crc32", "place", "shard").withColumn("one", F.lit(1).cast("long"))
    ranked = _running(placed, ["place", "doc_id", "tie"], "one", "rank")
    ranked = written(ranked, "ranked")
    before, starts = 0, F.lit(0).cast("long")
    for r in sorted(ranked.groupBy("shard").count().collect(), key=lambda r: r.shard):
        starts = F.when(F.col("shard") == r.shard, F.lit(before).cast("long")).otherwise(starts)
        before += r["count"]
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1 - starts).alias("slot"))


def op6_sharding(spark, sf_dir):
    from .common import table

    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
