"""Approximate nearest neighbours by inner product: lists of a coarse quantizer, adaptive dimension scan within them.

Largest inner product becomes smallest Euclidean distance by one more component, sqrt(M^2 - |x|^2) for vectors and 0
for queries. Lists come from k-means over a sample of at most ``SAMPLE`` distinct vectors; every vector is put in the
list of its nearest centre, and a query probes the ``PROBE`` share of the lists whose centres are nearest. Their number
is the root of the number of vectors, and at most an eighth of the sample.

Within a list vectors and queries are turned by one random rotation and compared in blocks of columns. After each
block, a candidate's partial squared distance, scaled to all dimensions, is tested against the distance of the
query's best so far: if it is too large by more than chance allows (a factor (1 + EPSILON / sqrt(d))^2 for d columns
seen), the candidate is abandoned. Survivors get their inner product from the original vectors in double precision.

Equal vectors are indexed once, with their smallest ids (k + 1 of them: no result can use more). Lists are dealt in
slices of at most ``SLICE`` vectors. Vectors are shuffled once, to their slice; queries go to the slices of the lists that
they probe, and pass by the slice's vectors, held in memory, as a stream in groups of ``QUERIES``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut

SAMPLE, PROBE, EPSILON, COLUMNS = 20_000, 0.65, 2.1, 16
SLICE, QUERIES = 16_384, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, key (equal for equal vectors) of the rows that take part: whole, finite, not zero, of the usual length."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (dims["d"] if dims else 0))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.xxhash64("v"))


def fit(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Centres of k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def extended(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, norm2 - (x**2).sum(axis=1)))[:, None]])


def scan(x: np.ndarray, q: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) numbers of the rows of ``x`` that may be among the k nearest to each of ``q``; both rotated.

    Rows come in chunks, and for all queries together a chunk's columns in blocks; after each block the test abandons
    candidates. While most are alive a block is one matrix product, afterwards only the survivors are computed.
    """
    d, best, found = x.shape[1], np.full((len(q), k), np.inf), []
    blocks = [(a, min(d, a + columns)) for a in range(0, d, columns)]
    for i in [0, *range(256, len(x), 1024)]:
        c = x[i : i + 1024 if i else 256]
        bound, part, on = best[:, -1:], np.zeros((len(q), len(c))), None
        rest = list(blocks)
        while rest and (on is None or on.mean() > 0.25):
            a, b = rest.pop(0)
            part += (c[:, a:b] ** 2).sum(axis=1) + (q[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * q[:, a:b] @ c[:, a:b].T
            on = part * (d / b) <= limit(bound, b, d, epsilon)
            part[~on] = np.inf
        of, row = np.nonzero(on)
        dist = part[of, row]
        for a, b in rest:
            dist = dist + ((c[row, a:b] - q[of, a:b]) ** 2).sum(axis=1)
            keep = dist * (d / b) <= limit(bound[of, 0], b, d, epsilon)
            of, row, dist = of[keep], row[keep], dist[keep]
        part[:] = np.inf
        part[of, row] = dist
        best = np.sort(np.concatenate([best, np.partition(part, min(k, part.shape[1]) - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
        near = dist <= best[of, -1] * (1 + 1e-9)
        found.append((of[near], row[near] + i, dist[near]))
    of, row, dist = (np.concatenate(f) for f in zip(*found, strict=True))
    near = dist <= best[of, -1] * (1 + 1e-9)
    return of[near], row[near]


def limit(bound, seen: int, d: int, epsilon: float):
    """What a scaled partial distance over ``seen`` of ``d`` columns may be, given the k-th best distance so far."""
    return bound * (1 + epsilon / math.sqrt(seen)) ** 2 + 1e-9 if seen < d else bound * (1 + 1e-9) + 1e-12


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, probe: float = PROBE, sample: int = SAMPLE, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose vec_id is divisible by ``every``.

    ``vectors``: vec_id and embedding; other columns are ignored. Rows with null id, and vectors that are null, empty,
    zero, not of the most frequent length, or hold null or non-finite components take no part. A query's own rows (all
    with its id) are no candidates. Ties go to the smaller vec_id. Fewer candidates than k: those that are found.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors), "vectors")
    by_id = Window.partitionBy("key").orderBy("vec_id")
    members = rows.select("key", "vec_id").distinct().withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= k + 1).drop("at")
    distinct = cut(rows.groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least")), "distinct-vectors")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n, norm2 = stats["n"], stats["m"] or 0.0
    out = "query_key long, key long, least long, score double"
    if not n:
        found = spark.createDataFrame([], out)
    else:
        few = distinct.select("v").orderBy(F.xxhash64("key", F.lit(3)), "key").limit(sample).toArrow()
        x = extended(matrix(few.column(0).combine_chunks()), norm2)
        lists = max(1, min(lists or max(1, min(n, len(x)) // 8), round(math.sqrt(n)), len(x)))
        c = fit(x, lists)
        turn, probes = rotation(x.shape[1]), max(1, math.ceil(probe * lists))
        step = max(1, (1 << 22) // lists)

        def assigned(batches):
            for b in batches:
                e = extended(matrix(b.column("v")), norm2)
                near = [(e[i : i + step] @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1) for i in range(0, len(e), step)]
                if near:
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), b.column("least"), pa.array(np.concatenate(near), pa.int32())], names=["key", "v", "least", "list"])

        def probing(batches):
            for b in batches:
                q = matrix(b.column("v"))
                for i in range(0, len(q), step):
                    far = 0.5 * (c**2).sum(axis=1) - q[i : i + step] @ c[:, :-1].T
                    near = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    part = b.slice(i, step)
                    yield pa.RecordBatch.from_arrays([part.column("query_key"), part.column("v"), pa.array(list(near), pa.list_(pa.int32()))], names=["query_key", "v", "lists"])

        placed = cut(distinct.select("key", "v", "least").mapInArrow(assigned, "key long, v array<double>, least long, list int"), "lists")
        slices = placed.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # a row a list, so at most an eighth of the sample
        asking = queries.groupBy(F.col("key").alias("query_key")).agg(F.first("v").alias("v")).mapInArrow(probing, "query_key long, v array<double>, lists array<int>")
        dealt = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
        left = placed.join(F.broadcast(slices), "list").select("list", dealt.alias("slice"), F.lit(False).alias("asks"), "key", "least", "v")
        right = asking.select("query_key", "v", F.explode("lists").alias("list")).join(F.broadcast(slices), "list")
        right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("asks"), F.col("query_key").alias("key"), F.lit(0).cast("long").alias("least"), "v")

        def search(batches):
            at, held, ready, waiting = None, [], None, []

            def answers():
                nonlocal ready
                if ready is None:
                    x = np.concatenate([h[0] for h in held])
                    ready = x, extended(x, norm2) @ turn, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                x, turned, key, least = ready
                q, query = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                waiting.clear()
                of, row = scan(turned, np.hstack([q, np.zeros((len(q), 1))]) @ turn, k + 1)
                score = (x[row] * q[of]).sum(axis=1)
                order = np.lexsort((least[row], -score, of))
                of, row, score = of[order], row[order], score[order]
                top = np.arange(len(of)) - np.searchsorted(of, of) <= k
                return pa.RecordBatch.from_pydict({"query_key": query[of[top]], "key": key[row[top]], "least": least[row[top]], "score": score[top]})

            for b in batches:
                groups = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
                edges = [0, *(np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1).tolist(), len(groups)]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if i == j:
                        continue
                    if at != tuple(groups[i, :2]):
                        if waiting and held:
                            yield answers()
                        at, held, ready, waiting = tuple(groups[i, :2]), [], None, []
                    part = b.slice(i, j - i)
                    v, key = matrix(part.column(5)), part.column(3).to_numpy()
                    if not groups[i, 2]:
                        held.append((v, key, part.column(4).to_numpy()))
                        continue
                    for y in range(0, len(v) if held else 0, QUERIES):
                        waiting.append((v[y : y + QUERIES], key[y : y + QUERIES]))
                        if sum(len(w[0]) for w in waiting) >= QUERIES:
                            yield answers()
            if waiting and held:
                yield answers()

        both = left.union(right).repartition("list", "slice").sortWithinPartitions("list", "slice", "asks")
        found = both.mapInArrow(search, out)
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "least")
    top = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).select("query_key", "key", "score")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key")).distinct()
    pairs = top.join(asked, "query_key").join(members, "key").filter("vec_id != query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
