"""Minimax contiguous sharding, in DataFrame functions only.

Rows with equal texts are one atomic group. Groups stand in the order of their texts'
SHA-256, and shards are contiguous runs of groups. The capacity is the smallest for which
a greedy pass, filling one shard after the other, needs no more shards than asked for.

The greedy pass only asks "how far does a shard reach from here", which is a look-up in
the groups' running sums. The driver holds at most MARKS of these sums: every k-th of
them first, then all those inside the few ranges that the marks leave open, until the
ranges are empty. So the search is exact, and what the driver holds doesn't grow.

Null texts count as empty and are grouped with them. An empty table gives no rows; fewer
groups than shards leave the last shards empty. Rows that repeat an id get slots of their
own. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut

#: Running sums that the driver holds at a time.
MARKS = 20_000


def _offsets(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each ``part``, the sums of ``columns`` in the parts before it; a row a partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    return sums.select("part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in columns])


def running(groups: DataFrame, order: list[str], sizes: list[str]) -> DataFrame:
    """Adds ``<size>_end``, the running sum of each size in the given order, without a global window."""
    dealt = cut(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(inside).alias(f"{c}_in") for c in sizes])
    out = out.join(F.broadcast(_offsets(dealt, sizes)), "part")
    return out.select(*groups.columns, *[(F.col(f"{c}_before") + F.col(f"{c}_in")).alias(f"{c}_end") for c in sizes])


class Marks:
    """Some of the running sums, and where others may lie between them."""

    def __init__(self, sums: list[int], total: int):
        self.sums, self.total = sorted({0, total, *sums}), total
        self.full: list[tuple[int, int]] = []

    def complete(self, low: int, high: int) -> bool:
        return any(a <= low and high <= b for a, b in self.full)

    def reach(self, limit: int) -> tuple[int, int]:
        """The least and the greatest that the largest running sum up to ``limit`` can be."""
        if limit >= self.total:
            return self.total, self.total
        i = bisect_right(self.sums, limit) - 1
        low = self.sums[i]
        return (low, low) if self.complete(low, limit) else (low, limit)

    def greedy(self, capacity: int, shards: int, low: bool) -> list[int]:
        """Ends of shards, each at its least (or greatest)."""
        out = [0]
        for _ in range(shards):
            out.append(self.reach(out[-1] + capacity)[0 if low else 1])
        return out

    def between(self, shards: int, largest: int) -> tuple[int, int]:
        """(a, b): no capacity up to a does, and b does."""
        a, b = max(largest, -(-self.total // shards)) - 1, self.total
        sure, x, y = b, a, b
        while y - x > 1:  # smallest that does even with the least reach
            m = (x + y) // 2
            if self.greedy(m, shards, True)[-1] >= self.total:
                sure = y = m
            else:
                x = m
        x, y = a, sure
        while y - x > 1:  # greatest that fails even with the greatest reach
            m = (x + y) // 2
            if self.greedy(m, shards, False)[-1] >= self.total:
                y = m
            else:
                x = m
        return x, sure


def minimax(sums: DataFrame, column: str, shards: int, largest: int, marks: int = MARKS) -> tuple[int, list[int]]:
    """(capacity, ends of shards as running sums) over the running sums in ``column``."""
    n, total = sums.agg(F.count(F.lit(1)), F.coalesce(F.max(column), F.lit(0))).first()
    if not n:
        return 0, [0] * shards
    open_ranges, found, turn = [(0, total)], Marks([], total), 0
    while True:
        inside = F.lit(False)
        for a, b in open_ranges:
            inside = inside | F.col(column).between(a, b)
        some = sums.where(inside)
        count = some.count()
        every = -(-count // marks)
        if every > 1:  # a hash picks about every k-th, others in each turn; which ones doesn't matter
            some = some.where(F.pmod(F.xxhash64(column, F.lit(turn)), F.lit(every)) == 0)
        found.sums = sorted({*found.sums, *(r[0] for r in some.select(column).collect())})
        known = sum(bisect_right(found.sums, b) - bisect_left(found.sums, max(a, 1)) for a, b in open_ranges)
        if known >= count:  # sums rise by at least 1, so all are different
            found.full += open_ranges
        low, high = found.between(shards, largest)
        first, last = found.greedy(low + 1, shards, True), found.greedy(high, shards, False)
        if high - low == 1 and first == last:
            return high, first[1:]
        ranges: list[tuple[int, int]] = []
        for a, b in zip(first[1:], last[1:]):
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        found.sums = [x for x in found.sums if any(a <= x <= b for a, b in ranges) or x in (0, total)]
        open_ranges = [r for r in ranges if not found.complete(*r)]
        turn += 1


def assign(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, group (SHA-256), shard, slot of each row.

    ``size``: UTF-8 bytes of the text plus 1. ``slot`` numbers a shard's rows from 0, by
    group and key. Texts are read once and never shuffled: groups are summed before they
    are, and rows are dealt by ranges of (group, key), which splits a group of any size.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("crc"), F.unhex(F.sha2(whole, 256)).alias("group"))
    rows = cut(rows)
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    sums = cut(running(groups, ["group"], ["size", "n"]))
    largest = sums.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    _, ends = minimax(sums.select("size_end"), "size_end", shards, largest)
    cutters = sums.where(F.col("size_end").isin(ends[:-1])).select("size_end", "n_end", F.hex("group").alias("group")).collect()
    last = {r.size_end: (r.n_end, r.group) for r in cutters}
    shard, before = F.lit(0), F.lit(0).cast("long")
    for i, e in enumerate(ends[:-1]):
        if e in last:
            n, group = last[e]
            past = F.col("group") > F.unhex(F.lit(group))
            shard, before = F.when(past, i + 1).otherwise(shard), F.when(past, F.lit(n).cast("long")).otherwise(before)
    dealt = rows.repartitionByRange("group", "key").sortWithinPartitions("group", "key", "size", "crc").withColumn("at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("part", F.shiftright("at", 33)).withColumn("one", F.lit(1)))
    placed = dealt.join(F.broadcast(_offsets(dealt, ["one"])), "part")
    slot = F.col("one_before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - before
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.hex("group").alias("group"), shard.cast("int").alias("shard"), slot.alias("slot"))


def contract(docs: DataFrame) -> DataFrame:
    """The columns of the query: law ``bytes``, 16 shards."""
    out = assign(docs, 16)
    return out.select("doc_id", "size", F.col("text_crc32").cast("long"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
