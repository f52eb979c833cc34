"""N-gram Jaccard join: a metric-space join, exact, over the distinct shingle sets of all documents.

Jaccard distance is a metric. The join looks for all pairs of sets at a distance of at most eps = 1 - 0.8 and returns the
groups that they connect. Pivots are sets of the corpus itself.

1. A set's name is 64 bits of a 128-bit fingerprint; names that two fingerprints share are looked for and given up
   (``shared_names``), so sets are told apart by 128 bits. Sets are made from the texts in each of the four passes that
   need them: written once, they take more room than the texts. After the first, only of one row of each set's copies.
2. First pivots. Nearly all texts are at distance 1 from any few of them, so few pivots would put everything into every
   window. So a shingle picks them: in one order of all shingles (rare ones first), two sets within eps share one
   among their first places (the smaller, of n shingles, differs from the other in at most n / 9, the larger in at most
   n / 5). Of the sets that hold a shingle there, and whose sizes allow the distance, the first is the pivot, the others
   are attached to it; sets that are attached to nothing are alone with themselves. Pivots that share sets make one
   region; two sets within eps are always in one. This only picks pivots: what is linked is decided by distances.
3. In a region, pivots create Voronoi cells: a set belongs to its nearest pivot's cell, and by the triangle inequality to
   each other cell whose pivot is at most 2 eps farther (``cells``). Sets farther than ``REACH`` from all pivots, and by
   the same inequality those up to eps nearer, form the far cell; so no other cell needs a set farther than REACH + eps.
   A pivot's distances to all its region are known exactly, so its links are, and it leaves. Cells are joined
   recursively until no cell holds sets that are not connected already.
4. Regions of at most ``SETS`` sets are joined in one task; larger ones are split by the same cells as distributed steps,
   in slices. Where cells hardly split them, the sets that the pivots don't connect with the others meet all of them, by
   pairs of slices of bounded size, each a region of its own. That copies sets with the square of the region's, as is due
   for sets that are all near each other. Where sets are far from each other, a region is many first pivots that few sets
   are attached to; two sets within eps are attached to one of them, so each with its sets is a region of its own
   (``stars``) if that copies fewer sets.

Shuffled are: for each task, sorted hashes of all shingles (a few bytes each, to know the frequent ones), of the
windows' shingles, and whole sets only of documents that share a region with others. Nothing is dropped: what is known
of frequent shingles only affects the order, so the sizes of regions. That is, in 2 bits for each of at most 2^``ROOM``
places, whether one set, two or more hold a shingle of that place, and of at most ``HEAVY`` how many do. A text's own
shingles come first, so texts that chance alone would join, ever more in a larger corpus, share no region.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.llm.common import bitmap, cut, forget, input_partitions, small, unused
from sparkwright.llm.components import components
from sparkwright.llm.shingles import PLACE, U, mix, shingle_sets

EPS, REACH = 0.2, 0.4
HEAVY = 1 << 21
#: Places for what is known of all shingles, four for each that several sets hold, and at most 2^ROOM.
ROOM = 27
BITMAP = 26
FLUSH = 1 << 21
#: A region of at most so many sets and shingles is joined in one task; others by so many pivots at a time.
SETS, SHINGLES, PIVOTS = 128, 1 << 21, 16
#: Up to so many copies of each set, pairs of slices are made without a look at what else would do.
OFTEN = 8


def linked(common, a, b):
    return 100 * common >= 80 * (a + b - common)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """A set's 128 bits, as two signed numbers; 0, 0 of an empty one."""
    if not len(s):
        return 0, 0
    low, high = (int((mix(s ^ c).sum(dtype=np.uint64) + U(len(s))).astype(np.int64)) for c in (U(0x5851F42D4C957F2D), U(0x2545F4914F6CDD1D)))
    return low, high


def renamed(low: int, high: int) -> int:
    return int(mix(np.array([low, high]).astype(np.uint64) * PLACE[:2]).sum(dtype=np.uint64).astype(np.int64))


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes(a) for a in arrays))


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u4", len(types)), 4 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(t).reshape(-1) if n else np.zeros(0, t))
        at += n * width
    return out


def binary(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def by_bucket(sorted_hashes: np.ndarray, bits: int):
    """(bucket, from, to) of the runs that share their top ``bits``."""
    edges = np.searchsorted(sorted_hashes >> U(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
    return [(k, int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges)).tolist()]


def own_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, print, n, low, high (fingerprint; null without shingles) of each document."""

    def run(batches):
        for b in small(batches):
            ns, names = [], []
            for s in shingle_sets(binary(b.column(2)), k):
                ns.append(len(s))
                names.append(fingerprint(s) if len(s) else (None, None))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "print": b.column(1), "n": pa.array(ns, pa.int64()), "low": pa.array([x[0] for x in names], pa.int64()), "high": pa.array([x[1] for x in names], pa.int64())})

    return docs.mapInArrow(run, "doc_id long, print long, n long, low long, high long")


def shared_names(own: DataFrame) -> dict[tuple[int, int], int]:
    """New names for the fingerprints whose lower halves are equal; n^2 / 2^65 are expected among n sets."""
    prints = own.groupBy("low", "high").agg(F.lit(1).alias("one"))  # copies are one row before anything is sorted
    lists = prints.groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b"), F.collect_set("high").alias("of")).filter("a < b")
    return {(r["low"], h): renamed(r["low"], h) for r in lists.select("low", "of").collect() for h in r["of"]}


def named(own: DataFrame, names: dict[tuple[int, int], int]) -> DataFrame:
    """``own`` with node, a name that no other fingerprint has: the lower half, or one of ``names``; null without shingles."""
    node = F.col("low")
    for (low, high), new in names.items():
        node = F.when((F.col("low") == low) & (F.col("high") == high), F.lit(new)).otherwise(node)
    return own.withColumn("node", node)


def is_on(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    p = numbers & ((1 << BITMAP) - 1)
    return (bits[p >> 3] >> (p & 7) & 1).astype(bool)


def first_rows(own: DataFrame) -> np.ndarray:
    """A bitmap that has one row of each set, by xxhash64(doc_id, print); of other copies some, as the bits are shared."""
    return bitmap(own.filter("low is not null").groupBy("low", "high").agg(F.min(F.xxhash64("doc_id", "print")).alias("row")).select("row"), BITMAP)


def sets_of(batches, k: int, names: dict[tuple[int, int], int], first):
    """(node, set) of a task's rows (row, text) that ``first`` has, each set once."""
    seen = set()
    for b in small(batches):
        b = b.filter(pa.array(is_on(first.value, b.column(0).to_numpy())))
        for s in shingle_sets(binary(b.column(1)), k):
            if len(s) and (name := fingerprint(s)) not in seen:
                seen.add(name)
                yield names.get(name, name[0]), s


def frequencies(docs: DataFrame, k: int, bits: int, first) -> DataFrame:
    """(bucket, blob): how many of a task's distinct sets hold each shingle."""

    def run(batches):
        held, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held) >> U(24) << U(24), return_counts=True)
            rows = [(b, pack(np.diff(v[i:j] >> U(24), prepend=U(0)), np.minimum(c[i:j], 65535).astype("<u2"))) for b, i, j in by_bucket(v, bits)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        for _, s in sets_of(batches, k, {}, first):
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("row", "text").mapInArrow(run, "bucket int, blob binary")


#: The level of what three sets hold; levels are four times the logarithm.
THRICE = 6


def marked(places: np.ndarray, level: np.ndarray, n: int) -> bytes:
    """2 bits for each of ``n`` places: 1 where two sets hold a shingle, 2 where more do."""
    marks = np.zeros(n, np.uint8)
    marks[places] = 1
    marks[places[level >= THRICE]] = 2
    return (marks.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def heavy_shingles(blobs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The top 40 bits of the shingles in most sets, at most HEAVY, and a class that grows with the number of sets; marks of all, and into how many places (as a power of 2) they go."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        v, c = zip(*(unpack(x, "<u8", "<u2") for x in pdf["blob"]), strict=True)
        v, c = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in v]), np.concatenate(c).astype(np.int64)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        first = np.flatnonzero(np.diff(v, prepend=v[:1] ^ U(1)))
        total = np.add.reduceat(c, first)
        often = total >= 2
        level = np.minimum(255, np.log2(total[often]) * 4).astype(np.uint8)
        return pd.DataFrame({"levels": [np.bincount(level, minlength=256).tolist()], "blob": [pack(np.diff(v[first][often], prepend=U(0)), level)]})

    counted = cut(blobs.groupBy("bucket").applyInPandas(count, "levels array<long>, blob binary"), "frequencies")
    sums = [x or 0 for x in counted.agg(*[F.sum(F.col("levels")[i]).alias(f"l{i}") for i in range(256)]).first()]
    least, total = 256, 0
    while least > THRICE and total + sums[least - 1] <= HEAVY:
        least -= 1
        total += sums[least]
    room = max(bits + 2, min(ROOM, (4 * sum(sums)).bit_length()))

    def keep(frames):
        for f in frames:
            for blob in f["blob"]:
                v, level = unpack(blob, "<u8", "u1")
                if len(v):
                    v = np.cumsum(v, dtype=np.uint64)
                    at = int(v[0] >> U(40 - bits)) << room - bits  # the first place of this bucket
                    marks = marked((v >> U(40 - room)).astype(np.int64) - at, level, 1 << room - bits)
                    yield pd.DataFrame({"at": [at >> 2], "marks": [zstandard.ZstdCompressor(level=1).compress(marks)], "blob": [pack(v[level >= least], level[level >= least])]})

    marks, found = np.zeros(1 << room - 2, np.uint8), [(np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
    for r in counted.select("blob").mapInPandas(keep, "at long, marks binary, blob binary").collect():
        of = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["marks"]), np.uint8)
        marks[r["at"] : r["at"] + len(of)] = of
        found.append(unpack(r["blob"], "<u8", "u1"))
    forget(counted)
    v, level = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(v)
    return v[order], level[order], marks, room


def commonness(s: np.ndarray, v: np.ndarray, level: np.ndarray, marks: np.ndarray, room: int) -> np.ndarray:
    """A number for each shingle that grows with how many sets hold it: 0 of one set, 1 of two, 2 of more (or of places shared with such), then by level."""
    place = (s >> U(64 - room)).astype(np.int64)
    often = marks[place >> 2] >> (place << 1 & 6).astype(np.uint8) & np.uint8(3)
    more = np.flatnonzero(often == 2)
    if len(v) and len(more):
        top = s[more] >> U(24)
        at = np.minimum(np.searchsorted(v, top), len(v) - 1)
        often[more] = np.where(v[at] == top, level[at] - np.uint8(THRICE - 3), np.uint8(2))
    return often


def root_regions(docs: DataFrame, k: int, names: dict, bits: int, heavy, first) -> DataFrame:
    """(bucket, blob): the shingles in each set's first places, with the set, its size and whether the smaller set's bound holds."""

    def run(batches):
        held, nodes, size = [], [], 0

        def flush():
            s, place, near = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(s)
            s, place, near = s[order], place[order], near[order]
            ids, ns = np.array([x[0] for x in nodes], "<i8"), np.array([x[1] for x in nodes], "<u4")
            rows = []
            for b, i, j in by_bucket(s, bits):
                used, local = np.unique(place[i:j], return_inverse=True)
                rows.append((b, pack(np.diff(s[i:j], prepend=U(0)), local.astype("<u4"), near[i:j].astype("u1"), ids[used], ns[used])))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        for node, s in sets_of(batches, k, names, first):
            n, often = len(s), commonness(s, *heavy.value)
            wide, narrow = n - -(-4 * n // 5) + 1, n - -(-8 * n // 9) + 1
            least = np.lexsort((mix(s ^ STEP_ORDER), often))[:wide]
            held.append((s[least], np.full(wide, len(nodes)), np.arange(wide) < narrow))
            nodes.append((node, n))
            size += wide
            if size >= FLUSH // 2:
                yield flush()
                held, nodes, size = [], [], 0
        if held:
            yield flush()

    return docs.select("row", "text").mapInArrow(run, "bucket int, blob binary")


STEP_ORDER = U(0xA0761D6478BD642F)


def attached(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a pivot, b a set attached to it) for each shingle of a bucket: all that hold it in places and with sizes that allow a pair."""
    parts = [unpack(x, "<u8", "<u4", "u1", "<i8", "<u4") for x in pdf["blob"]]
    s = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    node, n, near = (np.concatenate(x) for x in (([p[3][p[1]] for p in parts]), [p[4][p[1]] for p in parts], [p[2] for p in parts]))
    order = np.lexsort((node, 1 - near.astype(np.int8), n, s))
    s, node, n, near = s[order], node[order], n[order].astype(np.int64), near[order].astype(bool)
    place = np.arange(len(s))
    start = np.maximum.accumulate(np.where(np.diff(s, prepend=s[:1] ^ U(1)) != 0, place, 0))
    before = np.maximum.accumulate(np.where(near, place, -1))
    before = np.concatenate([[-1], before[:-1]])  # the last set before this one for which the smaller set's bound holds
    joined = (before >= start) & (100 * n[np.maximum(before, 0)] >= 80 * n)
    first = np.maximum.accumulate(np.where(near & ~joined, place, 0))  # of the chain that is open here
    at = np.flatnonzero(joined)
    a, b = node[first[before[at]]], node[at]
    pairs = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def common_with(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set (rows) shares with each pivot (columns)."""
    every, n = np.concatenate(sets), np.array([len(s) for s in sets])
    begin = np.cumsum(n) - n
    out = np.empty((len(sets), len(pivots)), np.int64)
    for j, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(p, every), len(p) - 1)
        out[:, j] = np.add.reduceat((p[at] == every).astype(np.int64), begin)
    return out


def measured(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard distances and links of each set (rows) with each pivot (columns)."""
    common = common_with(sets, pivots)
    n, m = np.array([len(s) for s in sets])[:, None], np.array([len(p) for p in pivots])[None, :]
    return 1 - common / (n + m - common), linked(common, n, m)


def cells(d: np.ndarray, eps: float = EPS, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Which Voronoi cells each set is in (nearest pivot, and those within its window), and which sets are in the far cell.

    Of two sets within eps let one be nearest to pivot p, at distance r. If r <= reach, the other is at most r + eps from
    p, and r is at most eps more than the other's own least distance. If r > reach, the other is farther than reach - eps
    from all pivots.
    """
    least = d.min(axis=1, keepdims=True)
    return d <= np.minimum(least + 2 * eps, reach + eps) + 1e-9, least[:, 0] > reach - eps - 1e-9


def groups_in(sets: list[np.ndarray], eps: float = EPS) -> np.ndarray:
    """For each set, the number of the first set that links connect it with; exact."""
    root = np.arange(len(sets))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    todo = [np.arange(len(sets))]
    while todo:
        idx = todo.pop()
        own = np.array([find(i) for i in idx])
        names, times = np.unique(own, return_counts=True)
        if len(names) < 2:
            continue
        here = [sets[i] for i in idx]
        # first a set of the smallest group, then what is farthest from all pivots
        chosen = [int(np.flatnonzero(own == names[times.argmin()])[0])]
        d, near = measured(here, [here[chosen[0]]])
        while len(chosen) < PIVOTS and d.min(axis=1).max() > REACH:
            chosen.append(int(d.min(axis=1).argmax()))
            more = measured(here, [here[chosen[-1]]])
            d, near = np.hstack([d, more[0]]), np.hstack([near, more[1]])
        for i, j in np.argwhere(near).tolist():
            a, b = sorted((find(idx[i]), find(idx[chosen[j]])))
            root[b] = a
        rest = np.setdiff1d(np.arange(len(idx)), chosen)
        if len(rest) < 2:
            continue
        inside, far = cells(d[rest], eps)
        if not (d[rest].min(axis=1) > REACH).any():
            far[:] = False
        parts = [idx[rest[x]] for x in (*inside.T, far) if x.sum() > 1]
        todo += parts if sum(map(len, parts)) <= 1.5 * len(rest) else [idx[rest]]  # cells that hardly differ are one
    return np.array([find(i) for i in range(len(sets))])


def whole_sets(docs: DataFrame, k: int, names: dict, bits, first) -> DataFrame:
    """node, n, shingles of each set whose place in the bitmap is set, once a task."""

    def run(batches):
        on, rows, size = bits.value, [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"node": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([len(r[1]) // 8 for r in rows], pa.int64()), "shingles": pa.array([r[1] for r in rows], pa.binary())})

        for node, s in sets_of(batches, k, names, first):
            p = node % (1 << BITMAP)
            if on[p >> 3] >> (p & 7) & 1:
                rows.append((node, s.tobytes()))
                size += len(s)
                if size >= FLUSH // 4:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return docs.select("row", "text").mapInArrow(run, "node long, n long, shingles binary")


def region_groups(members: DataFrame) -> DataFrame:
    """Links (a, b) of each region of ``members`` (region, node, shingles), each region joined in one task."""

    def run(frames):
        region, nodes, sets = None, [], []

        def done():
            got, root = {}, groups_in(sets) if len(sets) > 1 else []
            for i, r in enumerate(root):
                if i != r:
                    got.setdefault("a", []).append(nodes[r])
                    got.setdefault("b", []).append(nodes[i])
            return pd.DataFrame(got) if got else None

        for f in frames:
            for r, node, data in zip(f["region"], f["node"], f["shingles"], strict=True):
                if r != region:
                    if (out := done()) is not None:
                        yield out
                    region, nodes, sets = r, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(data, np.uint64))
        if (out := done()) is not None:
            yield out

    return members.select("region", "node", "shingles").repartition("region").sortWithinPartitions("region", "node").mapInPandas(run, "a long, b long")


def sliced(sizes: DataFrame, name: str = "slices") -> DataFrame:
    """region and into how many slices it is dealt."""
    return sizes.select("region", F.greatest(F.lit(1), F.ceil(2 * F.col("sets") / SETS), F.ceil(2 * F.col("weight") / SHINGLES)).cast("int").alias(name))


def placed(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members`` of large regions with pivot (boolean), to (pivots within eps) and in (names of the cells), PIVOTS of each region being pivots."""
    pick = Window.partitionBy("region").orderBy(F.xxhash64("node", "region"), "node")
    chosen = cut(members.select("region", "node", "shingles").withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= PIVOTS), "pivots")
    spread = sliced(sizes)
    left = members.join(spread, "region").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).drop("slices")
    right = chosen.join(spread, "region").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    columns = ["region", "node", "n", "shingles", "pivot", "to", "in"]

    def place(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        chosen = chosen.sort_values("rank").drop_duplicates("node")
        names = chosen["node"].to_numpy()
        d, near = measured([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], [np.frombuffer(x, np.uint64) for x in chosen["shingles"]])
        inside, far = cells(d)
        of = [[*(str(x) for x in names[i]), *(["far"] if f else [])] for i, f in zip(inside, far, strict=True)]
        return pdf[["region", "node", "n", "shingles"]].assign(pivot=pdf["node"].isin(names), to=[names[x].tolist() for x in near], **{"in": of})[columns]

    return left.groupBy("region", "slice").cogroup(right.groupBy("region", "slice")).applyInPandas(place, "region string, node long, n long, shingles binary, pivot boolean, to array<long>, in array<string>")


def pivot_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """region, first, group: the pivots of a region that sets connect, from its distinct lists ``to``."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for to in pdf["to"]:
        for x in to:
            a, b = sorted((find(to[0]), find(x)))
            root[b] = a
    return pd.DataFrame({"region": pdf["region"].iloc[0], "first": list(root), "group": [find(x) for x in root]})


def region_sizes(members: DataFrame, *more: str) -> DataFrame:
    return members.groupBy("region", *more).agg(F.count("*").alias("sets"), F.sum("n").alias("weight"))


def largest_groups(rest: DataFrame) -> DataFrame:
    """region, its largest group, how many sets that and all groups have."""
    counts = rest.groupBy("region", "group").agg(F.count("*").alias("c"))
    return counts.groupBy("region").agg(F.max_by("group", F.struct("c", "group")).alias("largest"), F.max("c").alias("most"), F.sum("c").alias("all"))


def stars(rest: DataFrame, sizes: DataFrame, attached: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Regions that pivots don't split and whose pairs of slices would copy each set often: (names of those that are cheaper
    by the first pivots of ``attached`` (a pivot, b), these stars as regions with ``fits``); None without any.

    A star whose sets are all connected is left out. Names of stars hold an @; they aren't split by stars again.
    """
    others = F.col("all") - F.col("most")
    copies = others * F.col("slices") + F.col("all") * F.ceil(2 * others / SETS)
    often = cut(largest_groups(rest.filter("not contains(region, '@')")).join(sliced(sizes), "region").select("region", copies.alias("copies")).filter(F.col("copies") > OFTEN * F.col("all")), "often")
    if not often.limit(1).count():
        return None
    to = attached.select(F.col("a").alias("star"), F.col("b").alias("node")).union(attached.select("a", "a")).distinct()
    held = rest.join(often, "region", "left_semi").join(to, "node")
    open_ = cut(held.groupBy("region", "star").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"), F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b"), "stars")
    cheaper = often.join(open_.groupBy("region").agg(F.sum("sets").alias("held")), "region", "left").filter("2 * coalesce(held, 0) < copies").select("region")
    fits = (F.col("sets") <= SETS) & (F.col("weight") <= SHINGLES)
    chosen = open_.join(cheaper, "region", "left_semi").select("region", "star", fits.alias("fits"))
    return cheaper, held.join(chosen, ["region", "star"]).select(F.concat_ws("@", "region", "star").alias("region"), "node", "n", "shingles", "fits")


def slice_pairs(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions that pivots don't split: what is not in a region's largest group meets all of it, by pairs of slices."""
    largest = largest_groups(rest).select("region", "largest")
    all_ = rest.join(largest, "region").join(sliced(sizes), "region").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    others = all_.filter("group <> largest")
    of = others.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(2 * F.count("*") / SETS), F.ceil(2 * F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    part = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    name = F.concat_ws("*", "region", "part", "own")
    a = others.join(of, "region").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).withColumn("own", part(F.col("slices")))
    b = all_.join(of, "region").withColumn("part", part(F.col("parts")))
    return a.select(name.alias("region"), "node", "n", "shingles").union(b.select(name.alias("region"), "node", "n", "shingles"))


def join_regions(members: DataFrame, attached: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets connected within the regions of ``members`` (region string, node, n, shingles).

    ``attached``: (a first pivot, b); those of a region's sets that are within eps are attached to one, or one to the other.
    """
    fits = (F.col("sets") <= SETS) & (F.col("weight") <= SHINGLES)
    sizes = cut(region_sizes(members), "region-sizes")
    if not sizes.filter(~fits).limit(1).count():
        return region_groups(members)
    found = region_groups(members.join(sizes.filter(fits).select("region"), "region", "left_semi"))
    large = cut(members.join(sizes.filter(~fits).select("region"), "region", "left_semi").dropDuplicates(["region", "node"]), "large-regions")
    while True:
        sizes = cut(region_sizes(large), "region-sizes")
        at = cut(placed(large, sizes), "placed")
        forget(large)
        first = F.get("to", F.lit(0))
        near = at.select(first.alias("a"), F.col("node").alias("b")).filter("a <> b").union(at.filter("size(to) > 1").select("to").distinct().select(first.alias("a"), F.explode("to").alias("b")).filter("a <> b"))
        groups = at.filter("size(to) > 0").select("region", "to").distinct().groupBy("region").applyInPandas(pivot_groups, "region string, first long, group long")
        rest = cut(at.filter("not pivot").withColumn("first", first).join(groups, ["region", "first"], "left").select("region", "node", "n", "shingles", "in", F.coalesce("group", "node").alias("group")), "rest")
        found = found.union(cut(near, "links"))
        forget(at)
        # cells whose sets are all connected are done; what is left of a region is split if its cells are really smaller
        open_ = cut(rest.select("region", "n", "group", F.explode("in").alias("cell")).groupBy("region", "cell").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"), F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b and sets > 1").join(sizes.select("region", F.col("sets").alias("of")), "region"), "cells")
        dense = open_.groupBy("region").agg((F.max(F.col("sets") / F.col("of")) > 0.75).alias("a"), (F.sum("sets") > 1.5 * F.max("of")).alias("b")).filter("a or b").select("region")
        whole = rest.join(dense, "region", "left_semi")
        starred = stars(whole, sizes, attached)
        found = found.union(region_groups(slice_pairs(whole.join(starred[0], "region", "left_anti") if starred else whole, sizes)))
        split = open_.join(dense, "region", "left_anti")
        name = F.concat_ws("/", "region", "cell").alias("region")
        parts = rest.withColumn("cell", F.explode("in")).join(split.select("region", "cell", fits.alias("fits")), ["region", "cell"]).select(name, "node", "n", "shingles", "fits")
        parts = parts.union(starred[1]) if starred else parts
        found = found.union(region_groups(parts.filter("fits")))
        more = parts.filter("not fits").drop("fits")
        if not (starred and more.limit(1).count() or split.filter(~fits).limit(1).count()):
            return found
        large = cut(more, "large-regions")
        found = cut(found, "links")
        forget(rest)


def grouped(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, print (of the text), n, root (null without shingles) of each row of ``docs`` (doc_id long, print long, text)."""
    spark = docs.sparkSession
    bits = max(6, (8 * input_partitions(spark) - 1).bit_length())
    own = cut(own_sets(docs, k), "sets")
    names = shared_names(own)
    first = spark.sparkContext.broadcast(first_rows(own))
    own = named(own, names)
    docs = docs.withColumn("row", F.xxhash64("doc_id", "print"))
    heavy = spark.sparkContext.broadcast(heavy_shingles(frequencies(docs, k, bits, first), bits))
    close = cut(root_regions(docs, k, names, bits, heavy, first).groupBy("bucket").applyInPandas(attached, "a long, b long").distinct(), "attached")
    links = None
    if close.limit(1).count():
        region = components(close)
        kept = spark.sparkContext.broadcast(bitmap(region.select("node"), BITMAP))
        members = cut(whole_sets(docs, k, names, kept, first).join(region, "node").select(F.col("root").cast("string").alias("region"), "node", "n", "shingles"), "members")
        links = cut(join_regions(members, close), "links")
        forget(members)
    forget(close)
    if links is None or not links.limit(1).count():
        rooted = own.withColumn("root", F.col("node"))
    else:
        rooted = own.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.select("doc_id", "print", "n", "root")


def printed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each row of ``docs`` (doc_id, text).

    Words are split by ASCII white space, A-Z lower-cased. A null text, or one without words, has no shingles and links
    with nothing: its component_id is its own doc_id. Exact copies are one set, whichever rows hold it; a null doc_id
    is the smallest of none, unless all of its component are null. Texts are whole, whatever their length; other columns,
    whatever their names, are ignored. An empty table gives no rows.
    """
    rooted = grouped(printed(docs), k)
    least = cut(rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    joined = rooted.join(least, "root", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (nulls last; then by the text's hash).

    Rows without shingles stay. Of rows that repeat both doc_id and text one stays, unless it has no shingles. Columns are
    unchanged, whatever their names; an empty table gives no rows.
    """
    ident, text_hash, own = unused(docs, 3)
    rooted = cut(grouped(printed(docs), k), "groups")
    first = rooted.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")).alias("f")).select("f.doc_id", "f.print")
    keep = first.union(rooted.filter("root is null").select("doc_id", "print")).select(F.col("doc_id").alias(ident), F.col("print").alias(text_hash)).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(text_hash))
    kept = marked.join(keep, same, "left_semi")
    repeated = rooted.filter("root is not null").groupBy("doc_id", "print").agg(F.count("*").alias("c")).filter("c > 1")
    if repeated.limit(1).count():
        twice = repeated.select(F.col("doc_id").alias(ident), F.col("print").alias(text_hash))
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
