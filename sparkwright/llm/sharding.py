"""Sharding: minimax contiguous partition of atomic groups.

Documents of equal texts are one group, known by the text's MD5, which is also the order of the groups; a group is never
divided. Of all ways to cut that order into shards, those whose largest shard is smallest are wanted: a binary search
finds the smallest capacity for which greedy filling needs no more shards than there are. A greedy step is a question for
the largest prefix sum that is not above a number. The prefix sums stay in a table, however many groups there are; the
driver holds a bounded number of segments (first and last sum, and how many sums lie between), answers with bounds, and
has only those segments resolved, by one aggregate a round, that the search still doubts.

Within the capacity the cuts fall as near to even shares as it allows: greedy filling would leave the last shards empty.
A group that is as large as an even share of what is left gets a shard of its own first, since it would set the capacity
of all others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, forget, unused
from sparkwright.operators.ordered import running

#: Segments that one round asks for, at most.
BINS = 1 << 15


def group_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


class Boundaries:
    """The prefix sums of ``table`` (upto long, ascending, ending with ``total``), as far as they are known, and 0."""

    def __init__(self, table: DataFrame, total: int, bins: int = BINS):
        self.table, self.total, self.bins = table, total, bins
        self.first, self.last, self.n = [0], [0], [1]
        self.resolve([(1, total)])

    def resolve(self, ranges: list[tuple[int, int]]) -> None:
        """Learn the sums in ``ranges`` (disjoint, ascending, whole segments) in finer segments."""
        each, place = max(2, self.bins // len(ranges)), None
        for i, (a, b) in enumerate(ranges):
            mine = F.col("upto").between(a, b)
            at = F.lit(i * each) + F.expr(f"(upto - {a}L) div {(b - a) // each + 1}L")
            place = F.when(mine, at) if place is None else place.when(mine, at)
        rows = self.table.groupBy(place.alias("at")).agg(F.min("upto").alias("a"), F.max("upto").alias("b"), F.count("*").alias("n")).filter("at is not null").collect()
        old = [s for s in zip(self.first, self.last, self.n, strict=True) if not any(a <= s[0] <= b for a, b in ranges)]
        every = sorted([*old, *((r["a"], r["b"], r["n"]) for r in rows)])
        self.first, self.last, self.n = ([s[i] for s in every] for i in range(3))

    def below(self, y: int) -> tuple[int, int]:
        """Bounds of the largest sum that is at most ``y`` >= 0."""
        i = bisect_right(self.first, y) - 1
        if y >= self.last[i]:
            return self.last[i], self.last[i]
        return self.first[i], self.first[i] if self.n[i] == 2 else min(y, self.last[i] - 1)

    def above(self, y: int) -> tuple[int, int]:
        """Bounds of the smallest sum that is at least ``y`` <= total."""
        i = bisect_left(self.last, y)
        if y <= self.first[i]:
            return self.first[i], self.first[i]
        return self.last[i] if self.n[i] == 2 else max(y, self.first[i] + 1), self.last[i]

    def doubtful(self, a: int, b: int) -> set[int]:
        """Segments with unknown sums that decide what is below or above a number from ``a`` to ``b``."""
        return {i for i in range(bisect_right(self.last, a), bisect_left(self.first, b)) if self.n[i] > 2}

    def resolve_segments(self, segments: set[int]) -> None:
        """Resolve neighbours together; or, where that would divide none of them for sure, the widest ones apart."""
        ranges: list[list[int]] = []
        for i in sorted(segments):
            if ranges and ranges[-1][2] == i - 1:
                ranges[-1][1:] = [self.last[i], i]
            else:
                ranges.append([self.first[i], self.last[i], i])
        each = max(2, self.bins // len(ranges))
        widest = sorted(segments, key=lambda i: self.first[i] - self.last[i])[:64]
        if self.last[widest[0]] - self.first[widest[0]] > max(b - a for a, b, _ in ranges) // each:
            self.resolve([(a, b) for a, b, _ in ranges])
        else:
            self.resolve([(self.first[i], self.last[i]) for i in sorted(widest)])


def reaches(known: Boundaries, capacity: int, shards: int, side: int) -> bool:
    """Does greedy filling use at most ``shards``: surely (side 0), or possibly (side 1)?"""
    x = 0
    for _ in range(shards):
        x = known.below(x + capacity)[side]
        if x >= known.total:
            return True
    return False


def smallest(known: Boundaries, shards: int, side: int) -> int:
    low, high = -(-known.total // shards), known.total
    while low < high:
        middle = (low + high) // 2
        if reaches(known, middle, shards, side):
            high = middle
        else:
            low = middle + 1
    return low


def capacity(known: Boundaries, shards: int) -> int:
    """The smallest capacity, exactly."""
    while True:
        a, b = smallest(known, shards, 1), smallest(known, shards, 0)
        if a == b:
            return a
        low = high = 0
        doubts: set[int] = set()
        for _ in range(shards):
            doubts |= known.doubtful(low + a, high + b)
            low, high = known.below(low + a)[0], known.below(high + b)[1]
            if low >= known.total:
                break
        known.resolve_segments(doubts)


def cuts(known: Boundaries, shards: int) -> list[int]:
    """The sums at which all shards but the last end: none above the capacity, each as near to an even share as that allows."""
    most, total = capacity(known, shards), known.total
    while True:
        doubts: set[int] = set()
        least = [(total, total)]  # where each shard must end, so that the rest fits
        for _ in range(shards - 1):
            low, high = (max(0, y - most) for y in least[-1])
            doubts |= known.doubtful(low, high)
            least.append((known.above(low)[0], known.above(high)[1]))
        found, x = [], (0, 0)
        for k in range(shards, 1, -1):  # shards that are left; the one to be cut must end at least at least[k - 1]
            need = least[k - 1]
            share = [y + (total - y) // k for y in x]
            doubts |= known.doubtful(share[0], min(total, share[1] + 1))
            low, high = known.below(share[0])[0], known.above(min(total, share[1] + 1))[1]
            if x[0] == x[1] and not known.doubtful(share[0], min(total, share[0] + 1)):
                # the nearer one; an even share is x + (total - x) / k, so both sides are taken k times
                low = high = low if low > x[0] and 2 * (x[0] * k + total - x[0]) <= (low + high) * k else high
            fits = known.below(x[0] + most)[0], known.below(x[1] + most)[1]
            doubts |= known.doubtful(x[0] + most, x[1] + most)
            x = max(min(low, fits[0]), need[0]), max(min(high, fits[1]), need[1])
            found.append(x)
        if not doubts:
            return [a for a, _ in found]
        known.resolve_segments(doubts)


def shard_of(sizes: DataFrame, shards: int) -> Column:
    """The shard (from 0) of a row of ``sizes`` (key string, size long), as an expression of its column ``key``.

    A row a group is summed and put in order by range partitions; at most shards - 1 large groups and as many cuts come
    to the driver. No groups: all are 0.
    """
    groups = cut(sizes.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    left = groups.agg(F.sum("size").alias("s")).first()["s"] or 0
    own: list[str] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if len(own) == shards - 1 or r["size"] * (shards - len(own)) < left:
            break
        own.append(r["key"])
        left -= r["size"]
    place = F.lit(len(own))
    if left > 0 and shards - len(own) > 1:
        rest = groups.filter(~F.col("key").isin(own)) if own else groups
        table = cut(running(rest, ["key"], {"upto": F.col("size")}).select("key", "upto"), "prefix-sums")
        ends = cuts(Boundaries(table, left), shards - len(own))
        for r in table.filter(F.col("upto").isin(ends)).collect():
            place = place + ends.count(r["upto"]) * (F.col("key") > r["key"]).cast("int")
        forget(table)
    forget(groups)
    for i, key in enumerate(own):
        place = F.when(F.col("key") == key, i).otherwise(place)
    return place.cast("int")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` (text, any other columns) with the column ``shard``, from 0; a column of that name is replaced.

    Documents stay where they lie: only group sums and the cuts are computed. Null texts count as empty ones.
    """
    key = unused(docs, 1)[0]
    place = shard_of(docs.select(group_key(F.col("text")).alias("key"), byte_size(F.col("text")).alias("size")), shards)
    named = docs.withColumn(key, group_key(F.col("text")))
    inner = named.select(F.col(key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("place", place)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"]
    return inner.select(*kept, F.col("place").alias("shard"))


def shard_plan(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs`` (doc_id, text).

    The law is ``bytes``: shards hold nearly equal sizes (UTF-8 bytes plus 1 a document), as far as equal texts, which stay
    together, allow. Null texts count as empty: size 1, checksum 0, of one group with them. Slots number a shard's rows
    from 0 by doc_id, null last, then by text; rows that are equal in both are numbered in any order. Other columns are
    ignored; an empty table gives no rows; with fewer groups than shards the last shards stay empty.
    """
    text = F.col("text").cast("string")
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), group_key(text).alias("key")), "sizes")
    placed = slim.withColumn("shard", shard_of(slim.select("key", "size"), shards)).withColumn("tie", F.monotonically_increasing_id())
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # a row a shard
    before = F.array(*[F.lit(sum(counts.get(j, 0) for j in range(i))).cast("long") for i in range(shards)])
    ran = running(placed, ["shard", F.col("doc_id").asc_nulls_last(), "key", "tie"], {}, "number")
    slot = F.col("number") - 1 - F.element_at(before, F.col("shard") + 1)
    return ran.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
