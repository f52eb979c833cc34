"""Filter interaction audit: subset-zeta transform.

Each document gets a mask with one bit for each filter that it fails. Counts by part and mask, at most 2**filters of each
part, are all that is needed: the transform sums them over subsets, so that the survivors of any set S of filters are
the sum over the masks within the complement of S. A filter's step in an order is the difference between two
neighbouring subsets; counts of documents labelled good and toxic go the same way.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut
from sparkwright.llm.sharding import group_key

COUNTS = ["n", "good", "toxic"]
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failing(text: Column) -> dict[str, Column]:
    """The filters that look at the text alone, by name: is it failing?"""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters=failing, duplicates: str | None = "E") -> tuple[DataFrame, list[str]]:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, text, source), and the filters' names, bit by bit.

    ``duplicates`` names a filter that fails for a row whose text (128 bits of it) a row of a smaller doc_id has. The
    first row of a text is found by text and doc_id together, so that a text of very many rows stays dealt.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = filters(F.col("text"))
    mask = F.lit(0)
    for bit, fail in enumerate(fails.values()):
        mask = mask + F.coalesce(fail, F.lit(False)).cast("int") * (1 << bit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = cut(rows.select("doc_id", "part", mask.alias("mask"), group_key(F.col("text")).alias("key")), "masks")
    names = [*fails]
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks.filter("good = 1 or toxic = 1"), "doc_id", "left")
    if duplicates:
        firsts = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
        repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
        marked = marked.join(firsts, ["key", "doc_id"], "left").withColumn("mask", F.col("mask") + repeated.cast("int") * (1 << len(names)))
        names.append(duplicates)
    counted = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in COUNTS[1:]])
    return counted, names


def within(counts: np.ndarray) -> np.ndarray:
    """The subset-zeta transform over the last axis (2**k masks): each mask's sum over its subsets."""
    k = counts.shape[-1].bit_length() - 1
    cube = counts.reshape(*counts.shape[:-1], *[2] * k)
    for axis in range(cube.ndim - k, cube.ndim):
        cube = np.cumsum(cube, axis=axis)
    return cube.reshape(counts.shape)


def steps(counts: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
    """What ``OUT`` lists after ``part``, for one part's ``counts`` (three by 2**filters)."""
    k, full = len(names), (1 << len(names)) - 1
    kept = within(counts)[:, full ^ np.arange(full + 1)]  # by the set of filters applied
    removed = {(s, f): kept[:, s] - kept[:, s | 1 << f] for f in range(k) for s in range(full + 1) if not s >> f & 1}
    shapley = [sum(math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) * int(r[0]) for (s, g), r in removed.items() if g == f) for f in range(k)]
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for order in permutations(range(k)):
        applied = 0
        for at, f in enumerate(order, 1):
            gone = removed[applied, f]
            after = applied | 1 << f
            values = ("".join(names[g] for g in order), at, kept[0, after], gone[0], removed[0, f][0] - gone[0], removed[full ^ 1 << f, f][0], gone[1], gone[2], shapley[f])
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
            applied = after
    return {c: np.array(v) for c, v in out.items()}


def filter_audit(docs: DataFrame, labels: DataFrame, filters=failing, duplicates: str | None = "E") -> DataFrame:
    """The columns ``OUT``: for each part, every order of the filters and every step of it.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic. A part is a source, null being the empty string
    (one part with sources that are empty). A null text is an empty one. A row without doc_id repeats nobody and is
    repeated by nobody; rows of one doc_id and text don't repeat each other. Labels of a doc_id that come more than once
    are good or toxic if one of them is; null labels are neither. Other columns are ignored. No documents: no rows.
    """
    counted, names = mask_counts(docs, labels, filters, duplicates)
    wide = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("rows"))  # at most 2**filters a part

    def audit(frames):
        for frame in frames:
            for part, rows in zip(frame["part"], frame["rows"], strict=True):
                counts = np.zeros((len(COUNTS), 1 << len(names)), np.int64)
                for r in rows:
                    counts[:, r["mask"]] += [r[c] for c in COUNTS]
                yield pd.DataFrame({"part": part} | steps(counts, names))

    return wide.mapInPandas(audit, OUT)
