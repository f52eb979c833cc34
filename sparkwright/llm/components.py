"""Connected components of links that stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, forget


#: Links that are connected in one task before the distributed rounds.
LINKS = 1 << 16


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: of each LINKS in a task, one from each node to the least that it reaches there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def flush():
            own = [(find(x), x) for x in root]
            linked = {r for r, x in own if r != x}
            own = [(r, x) for r, x in own if r != x or x not in linked]
            return pd.DataFrame({"a": [r for r, _ in own], "b": [x for _, x in own]}, dtype="int64")

        n = 0
        for f in frames:
            for x, y in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
                least, other = sorted((find(x), find(y)))
                root[other] = least
            n += len(f)
            if n >= LINKS:
                yield flush()
                n = 0
                root.clear()
        if n:
            yield flush()

    return links.select("a", "b").coalesce(links.count() // LINKS + 1).mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of ``links`` (a, b), a table as ``cut`` gives it; links may repeat.

    Each round gives a node the least root among its neighbours' and its own, then its root's root; the rounds needed
    grow with the logarithm of the longest path. Each round's table is written to the shared folder, the one before it deleted.
    """
    ends = cut(forest(links), "forest")
    both = cut(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    forget(ends)
    roots = table = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        of = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut(step.join(of, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "was"), "roots")
        forget(table)
        table, roots = jumped, jumped.select("node", "root")
        if not jumped.filter("root < was").limit(1).count():
            forget(both)
            return roots
