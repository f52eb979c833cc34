import random
import zlib
from itertools import accumulate

import pytest

from sparkwright.llm import sharding
from sparkwright.llm.sharding import Boundaries, capacity, cuts, shard_plan, sharded

from .helpers import documents, empty, frame


def least_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    ends = [0, *accumulate(sizes)]
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize(("seed", "n", "shards", "bins"), [(1, 60, 4, 8), (2, 200, 7, 16), (3, 40, 16, 1 << 15), (4, 300, 5, 2), (5, 9, 3, 4)])
def test_capacity_is_the_smallest_and_cuts_keep_it(spark, seed, n, shards, bins):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 9, 50, 400]) for _ in range(n)]
    sums = list(accumulate(sizes))
    table = spark.createDataFrame([(x,) for x in sums], "upto long")
    want = least_capacity(sizes, shards)
    assert capacity(Boundaries(table, sums[-1], bins), shards) == want
    ends = cuts(Boundaries(table, sums[-1], bins), shards)
    assert len(ends) == shards - 1 and ends == sorted(ends) and set(ends) <= {0, *sums}
    assert max(b - a for a, b in zip([0, *ends], [*ends, sums[-1]], strict=True)) == want
    assert ends == cuts(Boundaries(table, sums[-1], 1 << 15), shards)


def test_even_shares_where_greedy_filling_would_leave_shards_empty(spark):
    table = spark.createDataFrame([(i,) for i in range(10, 1010, 10)], "upto long")
    ends = cuts(Boundaries(table, 1000), 16)
    got = [b - a for a, b in zip([0, *ends], [*ends, 1000], strict=True)]
    assert max(got) == 70 and min(got) == 60  # greedy filling: 14 of 70, one of 20, one of none


def checked(rows, plan, shards):
    """Groups whole, slots gapless, checksums and sizes right; the size of each shard."""
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in plan), key=str) == want
    of = {}
    for r in plan:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in of.values())
    sizes = [0] * shards
    for s in range(shards):
        mine = sorted((r for r in plan if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        ids = [r["doc_id"] for r in mine if r["doc_id"] is not None]
        assert ids == sorted(ids) and all(r["doc_id"] is None for r in mine[len(ids) :])
        sizes[s] = sum(r["size"] for r in mine)
    return sizes


def test_plan_of_awkward_documents(spark):
    rows = documents(5)
    df = frame(spark, rows)
    plan, again = shard_plan(df, 5).collect(), shard_plan(df.repartition(7), 5).collect()
    checked(rows, plan, 5)
    assert {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in plan} == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in again}
    assert sharding.shard_plan(empty(spark)).count() == 0


def test_hot_group_has_its_own_shard_and_the_rest_is_even(spark):
    rows = [(i, "the same text of a third of all rows" * 3, "en", "s") for i in range(400)] + [(1000 + i, f"text number {i} " * 10, "en", "s") for i in range(600)]
    rows += [(2000, None, "en", None), (2001, "", None, "s"), (2000, None, "en", None)]
    sizes = checked(rows, shard_plan(frame(spark, rows), 8).collect(), 8)
    rest = sorted(sizes)[:-1]
    assert sizes[0] == max(sizes) == 400 * 109 and rest[-1] - rest[0] <= 2 * 200


def test_fewer_groups_than_shards(spark):
    rows = [(1, "a", "en", "s"), (2, "bb", "en", "s"), (3, "a", "en", "s")]
    sizes = checked(rows, shard_plan(frame(spark, rows), 16).collect(), 16)
    assert sorted(sizes)[-2:] == [3, 4] and sum(sizes) == 7


def test_sharded_keeps_columns_and_agrees(spark):
    df = spark.createDataFrame([(i, f"text {i % 30}", i, 1.5, "k", 9) for i in range(90)], "doc_id long, text string, `a.b` int, own_0 double, key string, shard int")
    out = sharded(df, 4)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == 90
    plan = {r["doc_id"]: r["shard"] for r in shard_plan(df, 4).collect()}
    assert {r["doc_id"]: r["shard"] for r in out.collect()} == plan and {(r["a.b"], r["own_0"], r["key"]) for r in out.collect()} == {(i, 1.5, "k") for i in range(90)}
