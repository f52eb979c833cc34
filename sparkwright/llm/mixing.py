"""Mixing sources to target weights.

Tokens are summed for each source; each source's target is its share by weight of the mix's size, at most ``most``
times the source's own size, what is above being shared again by weight among the others (the level L at which the sum
of min(cap, L * weight) is the mix's size). A source's rate is target / size; each document comes floor(rate) times,
and once more where its hash, seeded, falls below the fraction. Of ``DRAWS`` seeds each source takes the one whose sum
comes nearest to its target (of equally near ones the first): the sums of all of them are one pass over sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, forget, unused
from sparkwright.operators.ordered import running

DRAWS = 32


def words(text: Column) -> Column:
    """The number of words split by ASCII white space; a null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, size): one row per source.

    Weights go to the sources by code point, null last, repeating. A source of size 0 gets target 0. Sources may be many:
    places and sums over them are counted by range partitions.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(total, [F.col("source").asc_nulls_last()], {}, "rank")
    at = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = placed.select("source", "source_size", "rank", at.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")).withColumn("at", F.col("cap") / F.col("weight"))
    ran = running(named, ["at", "rank"], {"caps": F.col("cap"), "weights": F.col("weight")})
    whole = named.agg((F.lit(float(share)) * F.sum("source_size")).alias("mix"), F.sum("weight").alias("all_weights"))
    level = (F.col("mix") - (F.col("caps") - F.col("cap"))) / (F.col("all_weights") - (F.col("weights") - F.col("weight")))
    levels = ran.crossJoin(F.broadcast(whole)).withColumn("level", level).withColumn("full", F.col("at") <= F.col("level"))
    water = levels.agg(F.min(F.when(~F.col("full"), F.struct("at", "rank", "level")))["level"].alias("water"))
    return levels.crossJoin(F.broadcast(water)).select("source", "source_size", F.when(F.col("full") | F.col("water").isNull(), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def uniform(seed: int, draw: Column) -> Column:
    """A number in [0, 1) that the seed, the draw and doc_id fix: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, seed: int, draw: Column) -> Column:
    return F.floor(rate) + (uniform(seed, draw) < rate - F.floor(rate)).cast("long")


def source_draws(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """of_source, source_size, target, rate, draw for each source of ``sizes`` (doc_id, source, size), written."""
    targets = source_targets(sizes.select("source", "size"), weights, share, most).withColumnRenamed("source", "of_source")
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["of_source"]))
    own = ["of_source", "source_size", "target", "rate"]
    draws = joined.select(*own, "doc_id", "size", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw"))
    sums = draws.groupBy(*own, "draw").agg(F.sum(copies(F.col("rate"), seed, F.col("draw")) * F.col("size")).alias("taken"))
    best = F.min(F.struct(F.abs(F.col("taken").cast("double") - F.col("target")).alias("off"), "draw"))["draw"]
    return cut(sums.groupBy(*own).agg(best.alias("draw")), "source-draws")


def sized(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (= copies * size) of each row of ``docs`` (doc_id, source, text).

    Documents without words have size 0, whatever the length of their text; null doc_ids share one draw, and rows with
    equal doc_id are drawn alike; documents of a null source form a source. Other columns are ignored; an empty table gives
    no rows. Rows are never moved to a key: the sources' rows, one each, are joined to them.
    """
    sizes = sized(docs)
    drawn = source_draws(sizes, weights, share, most, seed)
    joined = sizes.join(drawn, sizes["source"].eqNullSafe(drawn["of_source"])).withColumn("copies", copies(F.col("rate"), seed, F.col("draw")))
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan says, with its own columns only, whatever their names.

    The sources' rates and draws are computed first, then applied to the documents where they lie, so texts are not
    shuffled. Null texts and those without words have size 0 and come as often as their source's rate says; a source of
    size 0 gives nothing; repeated rows are drawn alike; an empty table gives no rows.
    """
    source, rate, draw, copy = unused(docs, 4)
    sizes = sized(docs)
    drawn = source_draws(sizes, weights, share, most, seed).select(F.col("of_source").alias(source), F.col("rate").alias(rate), F.col("draw").alias(draw))
    forget(sizes)
    joined = docs.join(drawn, F.col("source").eqNullSafe(F.col(source)))
    often = copies(F.col(rate), seed, F.col(draw)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), often))).select(*[F.col(f"`{c}`") for c in docs.columns])
