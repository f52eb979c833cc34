"""Benchmark decontamination: spaced-seed hashing.

Words are runs of letters and digits, lower-cased. A fixed mask over neighbouring words keeps the words at its ones and
ignores those at its zeros, so a window's hash survives substitutions there. Hashes of all windows of the
test items are joined with those of the documents; around each hit the words of item and passage are compared along
the hit's diagonal, and the longest stretch is taken of which at least ``agree`` fifths are equal words. A document is
contaminated by an item if that stretch has at least ``least`` words, or covers an item that is shorter. Items with fewer
words than ``SPAN`` are found as a whole: there is a mask for each way to ignore the fifth of their words that may differ.

The masks miss no such stretch: some window of some mask is free of substitutions, whichever fifth of the words they are
(enumerated for 12 to 25 words in the tests; of a longer stretch one half has 13 words or more and four fifths equal).

A bitmap, in which each of the items' hashes sets two places, goes to the documents' tasks: 32 bits a hash, from 128 KB to
32 MB; only windows whose two places are set, with the words around them, are shuffled. Items with equal words are
searched for once, and a hash that many passages share meets each distinct item once.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import bitmap, cut, small, unused
from sparkwright.llm.shingles import ALNUM, U, mix, windows, word_blocks

MASKS = ("1111011", "110000010111", "1110001011", "1110111")
SPAN = 12
LEAST, AGREE = 13, 4


def kept(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def short_masks(n: int) -> list[tuple[int, ...]]:
    """The places that stay of an item of n words, for each way to ignore as many as may differ."""
    gone = n - -(-AGREE * n // 5)
    return [tuple(i for i in range(n) if i not in c) for c in combinations(range(n), gone)]


def seeds(h: np.ndarray, lengths: list[int], masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """Hashes by position: one array for each mask, and one for each mask of each length of short items."""
    out = [mix(windows(h, len(mask), kept(mask)) + U(m + 1)) for m, mask in enumerate(masks)]
    return out + [mix(windows(h, n, places) + U(1000 * n + k)) for n in lengths for k, places in enumerate(short_masks(n))]


def lower_bytes(texts: list[str | None]) -> list[bytes | None]:
    return [t.lower().encode() if t else None for t in texts]


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, n, words (hashes), key (equal for items with equal words)."""

    def run(batches):
        for b in small(batches):
            texts, words = lower_bytes(b.column(1).to_pylist()), []
            for _, bounds, h in word_blocks(texts, ALNUM):
                words += [h[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"item_id": b.column(0), "n": pa.array([len(w) for w in words], pa.int64()), "words": pa.array([w.tobytes() for w in words], pa.binary())})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id long, n long, words binary").filter("n > 0").withColumn("key", F.sha2("words", 256))


def item_seeds(items: DataFrame) -> DataFrame:
    """key, hash, at of each window of each distinct item."""

    def run(frames):
        for f in frames:
            for key, data in zip(f["key"], f["words"], strict=True):
                h = np.frombuffer(data, np.uint64)
                for s in seeds(h, [len(h)], ()) if len(h) < SPAN else seeds(h, []):
                    if len(s):
                        yield pd.DataFrame({"key": key, "hash": s.astype(np.int64), "at": np.arange(len(s))})

    return items.select("key", "words").dropDuplicates(["key"]).mapInPandas(run, "key string, hash long, at long")


def passages(docs: DataFrame, bits, size: int, lengths: list[int], longest: int, keep: list[str]) -> DataFrame:
    """Stretches of documents around windows that pass the bitmap: keep..., pid, start, words, hits (hash, at)."""

    def run(batches):
        on = bits.value
        for b in small(batches):
            texts, rows = lower_bytes(b.column(len(keep)).to_pylist()), []
            for first, bounds, h in word_blocks(texts, ALNUM):
                found = []
                for s in seeds(h, lengths):
                    at = np.arange(len(s))
                    for shift in (0, size):
                        p = (s[at] >> U(shift) & U((1 << size) - 1)).astype(np.int64)
                        at = at[on[p >> 3] >> (p & 7) & 1 > 0]
                    found.append(np.stack([at, s[at].astype(np.int64)], axis=1))
                hits = np.concatenate(found)
                hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
                of = np.searchsorted(bounds, hits[:, 0], "right") - 1
                for d in np.unique(of).tolist():
                    own = hits[of == d]
                    for part in np.split(own, np.flatnonzero(np.diff(own[:, 0]) > longest) + 1):
                        lo, hi = max(int(bounds[d]), int(part[0, 0]) - longest), min(int(bounds[d + 1]), int(part[-1, 0]) + longest)
                        rows.append((first + d, uuid.uuid4().hex, lo - int(bounds[d]), h[lo:hi].tobytes(), [{"hash": int(x), "at": int(at) - lo} for at, x in part]))
            take = pa.array([r[0] for r in rows], pa.int64())
            own = [c.take(take) for c in b.columns[: len(keep)]]
            yield pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())])))], names=[*keep, "pid", "start", "words", "hits"])

    schema = docs.select(*keep, F.lit("").alias("pid"), F.lit(0).cast("long").alias("start"), F.lit(b"").alias("words"), F.expr("array(struct(0L as hash, 0L as at))").alias("hits")).schema
    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(run, schema)


def longest_stretch(equal: list[bool], agree: int = AGREE) -> tuple[int, int]:
    """(from, to) of the longest stretch of which at least ``agree`` fifths are equal, the first of several."""
    sums = [0]
    for e in equal:
        sums.append(sums[-1] + (5 - agree if e else -agree))
    low = [0]
    for i in range(1, len(sums)):
        if sums[i] < sums[low[-1]]:
            low.append(i)
    best, falling = (0, 0), [-sums[k] for k in low]
    for end in range(1, len(sums)):
        start = low[bisect_left(falling, -sums[end])] if -sums[end] <= falling[-1] else end
        if end - start > best[1] - best[0]:
            best = (start, end)
    return best


def contaminations(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """One row for each document and item whose words it holds: ``keep``, item_id, at (first word), overlap_words, equal_words.

    ``docs`` has the columns ``keep`` and text, ``benchmark`` item_id and text. Rows of ``docs`` that agree in ``keep``
    are one document; rows that repeat change nothing. Null and empty texts hold nothing; a null item_id is an item like
    others; either table may be empty. Texts are whole, whatever their length; of equally long stretches the one with more
    equal words counts, then the earlier. Other columns are ignored. Clean documents have no row.
    """
    spark = docs.sparkSession
    keep = list(keep)
    items = cut(item_words(benchmark), "items")
    spread = items.agg(F.max("n")).first()[0] or 0
    lengths = [r["n"] for r in items.filter(F.col("n") < SPAN).select("n").distinct().collect()]  # below SPAN different ones
    targets = cut(item_seeds(items), "item-seeds")
    size = min(28, max(20, (32 * targets.count()).bit_length()))
    places = targets.select("hash").union(targets.select(F.shiftright("hash", size)))
    bits = spark.sparkContext.broadcast(bitmap(places, size))
    found = cut(passages(docs, bits, size, lengths, max(int(spread), SPAN), keep), "passages")
    hits = found.select("pid", F.explode("hits").alias("h")).select("pid", "h.hash", F.col("h.at").alias("place")).distinct()
    diagonals = hits.join(targets, "hash").select("pid", "key", (F.col("place") - F.col("at")).alias("shift")).distinct()
    words = items.select("key", F.col("words").alias("item"), "n").dropDuplicates(["key"])
    pairs = diagonals.join(found.drop("hits"), "pid").join(words, "key")

    def verify(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                text, item, shift = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item"], np.uint64), r["shift"]
                lo, hi = max(0, -shift), min(len(item), len(text) - shift)
                if hi <= lo:
                    continue
                equal = item[lo:hi] == text[lo + shift : hi + shift]
                a, z = longest_stretch(equal.tolist())
                if z - a >= min(least, len(item)):
                    rows.append([r[c] for c in keep] + [r["key"], r["start"] + shift + lo + a, z - a, int(equal[a:z].sum())])
            yield pd.DataFrame(rows, columns=[*keep, "key", "at", "overlap_words", "equal_words"]) if rows else pd.DataFrame({c: [] for c in [*keep, "key", "at", "overlap_words", "equal_words"]})

    schema = pairs.select(*keep, "key", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("overlap_words"), F.lit(0).cast("long").alias("equal_words")).schema
    sure = pairs.select(*keep, "key", "shift", "start", "words", "item").mapInPandas(verify, schema)
    best = sure.groupBy(*keep, "key").agg(F.max(F.struct("overlap_words", "equal_words", (-F.col("at")).alias("at"))).alias("b"))
    named = items.select("key", "item_id").distinct()
    return best.join(named, "key").select(*keep, "item_id", (-F.col("b.at")).alias("at"), "b.overlap_words", "b.equal_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that hold words of an item, by text, so whatever their doc_id is, and equal texts alike.

    Columns are unchanged, whatever their names. A null or empty text holds nothing and stays, a null item finds nothing; an
    empty benchmark takes no row, empty ``docs`` stay empty.
    """
    (mark,) = unused(docs, 1)
    marked = docs.withColumn(mark, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    bad = contaminations(marked, benchmark, (mark,), least).select(mark).distinct()
    return marked.join(bad, mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
