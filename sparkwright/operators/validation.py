"""Declared rules over linked tables: keys, required fields, links, times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.relational import orphans


@dataclass(frozen=True)
class Rules:
    keys: dict[str, str]
    required: dict[str, tuple[str, ...]]
    links: tuple[tuple[str, str, str, str], ...]
    holds: tuple[tuple[str, str, Column], ...] = ()


def violations(tables: dict[str, DataFrame], rules: Rules) -> DataFrame:
    """rule, n of each broken rule."""
    parts = []
    for name, key in rules.keys.items():
        parts.append(tables[name].groupBy(key).agg(F.count("*").alias("c")).agg(F.lit(f"{name}.{key}:repeated").alias("rule"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n")))
    for name, columns in rules.required.items():
        counts = tables[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        parts.append(counts.unpivot([], list(columns), "c", "n").select(F.concat(F.lit(f"{name}."), "c", F.lit(":missing")).alias("rule"), "n"))
    for child, key, parent, parent_key in rules.links:
        parts.append(orphans(tables[child], key, tables[parent], parent_key).agg(F.lit(f"{child}.{key}:orphan").alias("rule"), F.count("*").alias("n")))
    for name, rule, holds in rules.holds:
        parts.append(tables[name].agg(F.lit(f"{name}:{rule}").alias("rule"), F.count_if(~F.coalesce(holds, F.lit(True))).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")
