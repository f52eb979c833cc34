"""Hard-negative mining: exact search with an orthogonal PCA rotation.

Vectors are made integer, so a score is an exact integer. For the search they are turned by the eigenvectors of the second
moments (of a bounded sample: it decides how early candidates go, not what is found), largest first. The leading
components' products are accumulated in blocks; what the remaining ones can add is at most the product of both residual
norms, and all roundings together at most a slack that follows from the norms and the rotation's measured departure from
orthogonality. A candidate whose bounds leave what is wanted is dropped; integer products of the survivors decide.

Rows of equal vector and label are one candidate with its smallest ids (no answer can use more). For the positives
candidates are dealt in slices of a label, for the negatives in slices of all; each anchor passes by its slices in a
stream.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut
from sparkwright.llm.nearest import matrix

SAMPLE, SLICE, ANCHORS, ROWS, COLUMNS = 20_000, 1 << 21, 512, 4096, 16


def integral(vectors: DataFrame, scale: int, shifted: Column | None) -> DataFrame:
    """vec_id, label, v (integers) of the rows that take part, each once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = dims["d"] if dims else 1
    most = F.lit(float(min(math.isqrt((1 << 63) // d - 1), (1 << 31) - 1)))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * float(scale), most), -most)).cast("int"))
    return rows.filter(F.size("v") == d).select("vec_id", (F.col("label") if shifted is None else shifted).alias("label"), whole.alias("v")).distinct()


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: the eigenvectors of the second moments, by falling value."""
    return np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1])


def slack(turn: np.ndarray) -> float:
    """By what share of both norms a product of turned vectors may differ from the integer product."""
    d = len(turn)
    return float(np.linalg.norm(turn.T @ turn - np.eye(d))) + float(np.linalg.norm(turn @ turn.T - np.eye(d))) + 16 * (d + 4) ** 1.5 * np.finfo(float).eps


class Turned:
    """Vectors, turned, with the norms of what is left after each block of columns."""

    def __init__(self, v: np.ndarray, turn: np.ndarray, columns: int = COLUMNS):
        self.v, self.y = v, v @ turn
        ends = [*range(columns, v.shape[1], columns), v.shape[1]]
        self.blocks = list(zip([0, *ends[:-1]], ends, strict=True))
        square = np.array([(self.y[:, b:] ** 2).sum(axis=1) for b in ends]).reshape(len(ends), len(v))
        self.left = np.sqrt(square) * (1 + 1e-9)
        self.norm = np.sqrt((v.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)

    def part(self, i: int, j: int) -> Turned:
        out = object.__new__(Turned)
        out.v, out.y, out.blocks, out.left, out.norm = self.v[i:j], self.y[i:j], self.blocks, self.left[:, i:j], self.norm[i:j]
        return out


def survivors(q: Turned, x: Turned, low: np.ndarray, high: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of all pairs whose score may lie from the anchor's ``low`` to its ``high``, and perhaps of some others.

    While a quarter of the pairs is alive a block is one matrix product, afterwards only those are computed.
    """
    part, on = np.zeros((len(q.v), len(x.v))), None
    rest = list(enumerate(q.blocks))
    while rest and (on is None or on.mean() > 0.25):
        n, (a, b) = rest.pop(0)
        part += q.y[:, a:b] @ x.y[:, a:b].T
        room = np.multiply.outer(q.left[n], x.left[n]) + share * np.multiply.outer(q.norm, x.norm)
        on = (part + room >= low[:, None]) & (part - room <= high[:, None])
    of, row = np.nonzero(on)
    value = part[of, row]
    for n, (a, b) in rest:
        value = value + (q.y[of, a:b] * x.y[row, a:b]).sum(axis=1)
        room = q.left[n][of] * x.left[n][row] + share * q.norm[of] * x.norm[row]
        keep = (value + room >= low[of]) & (value - room <= high[of])
        of, row, value = of[keep], row[keep], value[keep]
    return of, row


def products(q: np.ndarray, x: np.ndarray, of: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Integer products of the pairs, a bounded number at a time."""
    step = max(1, (1 << 21) // max(1, q.shape[1]))
    parts = [np.einsum("ij,ij->i", q[of[i : i + step]], x[row[i : i + step]]) for i in range(0, len(of), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def best(of: np.ndarray, row: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each anchor: higher scores, then smaller ids."""
    order = np.lexsort((least[row], -score, of))
    return order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < k]


def positives(q: Turned, x: Turned, least: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the k best rows of each anchor."""
    of, row, score = (np.zeros(0, np.int64) for _ in range(3))
    low, high = np.full(len(q.v), -np.inf), np.full(len(q.v), np.inf)
    for i in [0, *range(256, len(x.v), ROWS)]:
        a, b = survivors(q, x.part(i, i + ROWS if i else 256), low, high, share)
        of, row = np.concatenate([of, a]), np.concatenate([row, b + i])
        score = np.concatenate([score, products(q.v, x.v, a, b + i)])
        top = best(of, row, score, least, k)
        of, row, score = of[top], row[top], score[top]
        full = np.bincount(of, minlength=len(low)) >= k
        worst = np.full(len(low), np.inf)
        np.minimum.at(worst, of, score)
        low = np.where(full, worst, -np.inf)
    return of, row, score


def negatives(q: Turned, x: Turned, least: np.ndarray, k: int, share: float, scores: np.ndarray, band: tuple[int, int], label: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, positive, row, score) of the k best rows of other labels within each positive's band.

    ``scores``: anchors by positives, ``label`` and ``labels`` those of anchors and rows. Band: band[0] * positive <=
    100 * score <= band[1] * positive. Places without a positive are filled with a copy of one.
    """
    whole, rest = scores // 100, scores % 100  # so that no product leaves 64 bits
    bottom, top = band[0] * whole - (-band[0] * rest // 100), band[1] * whole + band[1] * rest // 100
    width = scores.shape[1]
    of, at, row, score = (np.zeros(0, np.int64) for _ in range(4))
    wanted = bottom.copy()
    open_ = bottom <= top
    for i in [0, *range(256, len(x.v), ROWS)]:
        low = np.where(open_, wanted, np.iinfo(np.int64).max).min(axis=1).astype(float)
        high = np.where(open_, top, np.iinfo(np.int64).min).max(axis=1).astype(float)
        a, b = survivors(q, x.part(i, i + ROWS if i else 256), low, high, share)
        other = label[a] != labels[b + i]
        a, b = a[other], b[other]
        s = products(q.v, x.v, a, b + i)
        pair, place = np.nonzero((s[:, None] >= bottom[a]) & (s[:, None] <= top[a]))
        of, at, row, score = np.concatenate([of, a[pair]]), np.concatenate([at, place]), np.concatenate([row, b[pair] + i]), np.concatenate([score, s[pair]])
        first = best(of * width + at, row, score, least, k)
        of, at, row, score = of[first], at[first], row[first], score[first]
        flat = of * width + at
        worst = np.full(wanted.size, np.iinfo(np.int64).max)
        np.minimum.at(worst, flat, score)
        wanted = np.where(np.bincount(flat, minlength=wanted.size) >= k, worst, bottom.reshape(-1)).reshape(wanted.shape)
    return of, at, row, score


def passing(slices: DataFrame, anchors: DataFrame, turn: np.ndarray, answer, schema: str) -> DataFrame:
    """Each anchor of a slice (part, slice, v, label, anchor, more) held against its rows (.., ids) by ``answer``.

    Sorted, so a slice's rows are held in memory and its anchors stream by in groups.
    """
    left = slices.select("part", "slice", F.lit(False).alias("asks"), "v", "label", F.lit(0).cast("long").alias("anchor"), F.col("ids").alias("more"))
    right = anchors.select("part", "slice", F.lit(True).alias("asks"), "v", "label", "anchor", "more")

    def joined(items):
        return [np.concatenate([x[i] for x in items]) for i in range(3)] + [[m for x in items for m in x[3]]]

    def run(batches):
        at, held, ready, waiting = None, [], None, []

        def answers():
            nonlocal ready
            if ready is None:
                v, label, _, ids = joined(held)
                ready = Turned(v, turn), label, np.array([i[0] for i in ids]), ids
                held[:] = [None]
            v, label, anchor, more = joined(waiting)
            waiting.clear()
            return answer(Turned(v, turn), label, anchor, more, *ready)

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
                for y in range(i, j, ANCHORS):
                    part = b.slice(y, min(j - y, ANCHORS))
                    item = matrix(part.column(3)).astype(np.int64), part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6).to_pylist()
                    if not groups[i, 2]:
                        held.append(item)
                    elif held:
                        waiting.append(item)
                        if sum(len(w[0]) for w in waiting) >= ANCHORS:
                            yield answers()
        if waiting and held:
            yield answers()

    return left.union(right).repartition("part", "slice").sortWithinPartitions("part", "slice", "asks").mapInArrow(run, schema)


def listed(ids: list[list[int]], row: np.ndarray) -> pa.Array:
    return pa.array([ids[r] for r in row.tolist()], pa.list_(pa.int64()))


def hard_negatives(vectors: DataFrame, every: int = 50, k: int = 5, n: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256, shifted: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of ``vectors`` (vec_id, embedding, label) whose vec_id is divisible by ``every``; positives the k
    best other rows of the same label; negatives the n best rows of other labels with a score from band[0] to band[1]
    hundredths of the positive's. Score: the product of floor(scale * component); ties go to the smaller vec_id.
    ``shifted`` may replace the label (an expression of vec_id and label).

    Rows take no part where vec_id, label, vector or a component is null, a component is not finite, or the vector is
    empty or not of the most frequent length. Components so large that a vector's product with itself would not fit a
    long are cut back to where it does. Rows equal in vec_id, label and vector count once; a vec_id that comes with several
    vectors is several rows, none of them a positive of another. A positive without such negatives gives no rows (so one
    with a negative score gives none). Other columns are ignored. No rows: none.

    Every anchor meets every row in bounded slices: work grows with the square of the rows, memory doesn't.
    """
    spark = vectors.sparkSession
    rows = cut(integral(vectors, scale, shifted), "integer-vectors")
    few = rows.select("v").orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(sample).toArrow()
    if not len(few):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    turn = rotation(matrix(few.column(0).combine_chunks()).astype(float))
    share, keep, size = slack(turn), max(k + 1, n), max(1, SLICE // len(turn))
    by_id = Window.partitionBy("label", "v").orderBy("vec_id")
    distinct = cut(rows.withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= keep).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    # an anchor is a vector with its label; the ids that have it come back at the end
    asking = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    anchors = cut(asking.groupBy("label", "v").agg(F.min("vec_id").alias("anchor")), "anchors")
    named = asking.join(anchors, ["label", "v"]).select("anchor", F.col("vec_id").alias("anchor_id"))

    def near(q, label, anchor, more, x, labels, least, ids):
        of, row, score = positives(q, x, least, k + 1, share)
        return pa.RecordBatch.from_pydict({"anchor": anchor[of], "ids": listed(ids, row), "score": score})

    sizes = distinct.groupBy(F.col("label").alias("part")).agg(F.ceil(F.count("*") / size).cast("int").alias("slices"))
    dealt = distinct.join(sizes, F.col("label") == F.col("part")).withColumn("slice", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int"))
    own = anchors.join(sizes, F.col("label") == F.col("part")).select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.array().cast("array<long>").alias("more"))
    same = passing(dealt, own, turn, near, "anchor long, ids array<long>, score long").select("anchor", F.explode("ids").alias("vec_id"), "score")
    # the k + 1 best of the anchor's vector hold the k best of each row that has it, itself left out
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    top = same.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    top = cut(top, "positives")

    def far(q, label, anchor, scores, x, labels, least, ids):
        given = np.array([[s[min(i, len(s) - 1)] for i in range(k + 1)] for s in scores], np.int64)
        of, at, row, score = negatives(q, x, least, n, share, given, band, label, labels)
        real = at < np.array([len(s) for s in scores])[of]
        of, at, row, score = of[real], at[real], row[real], score[real]
        return pa.RecordBatch.from_pydict({"anchor": anchor[of], "positive_score": given[of, at], "ids": listed(ids, row), "score": score})

    parts = max(1, -(-distinct.count() // size))
    everywhere = distinct.select("*", F.lit(0).cast("long").alias("part"), F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int").alias("slice"))
    asked = anchors.join(top.select("anchor", F.transform("best", lambda b: -b["s"]).alias("more")), "anchor").select("*", F.lit(0).cast("long").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice"))
    found = passing(everywhere, asked, turn, far, "anchor long, positive_score long, ids array<long>, score long").select("anchor", "positive_score", F.explode("ids").alias("negative_id"), F.col("score").alias("negative_score")).distinct()
    ranked = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    bands = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
    mine = Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    pairs = named.join(top.select("anchor", F.explode("best").alias("b")), "anchor").select("anchor", "anchor_id", F.col("b.vec_id").alias("positive_id"), (-F.col("b.s")).alias("positive_score")).filter("positive_id != anchor_id")
    pairs = pairs.withColumn("at", F.row_number().over(mine)).filter(F.col("at") <= k)
    return pairs.join(bands, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
