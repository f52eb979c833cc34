"""Draws of one sequential generator, made in parallel: the resampling that a single process with a seed would do.

The generator is the Mersenne Twister as Python's ``random.Random(seed)`` starts it. ``choice`` takes the upper bits of the
next word and passes over words that are too large. The driver runs through the words once, some nanoseconds each, and
keeps the state and the number of draws so far at the start of each block (at most ``BLOCKS`` of them, 2.5 KB each); tasks
make the draws of their blocks. So repetitions run apart and yet equal those of the one generator.

Uniform numbers of ``numpy.random.default_rng(seed)`` need no run: its generator (PCG64) can be set forward at once.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, BLOCKS = 1 << 20, 4096


def twister(state: tuple) -> np.random.MT19937:
    """The generator in a state of ``random.Random.getstate``."""
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[1][:-1], np.uint32), "pos": state[1][-1]}}
    return out


def picks(words: np.ndarray, n: int) -> np.ndarray:
    """The draws below ``n`` that these words give."""
    got = words >> np.uint64(32 - n.bit_length())
    return got[got < np.uint64(n)].astype(np.int64)


def blocks(seed: int, n: int, count: int, block: int = BLOCK) -> list[tuple[bytes, int, int, int]]:
    """(key, position, words, draws before) of each block, until ``count`` draws below ``n`` are made."""
    g, done, out = twister(random.Random(seed).getstate()), 0, []
    block = max(block, 2 * count // BLOCKS)
    while done < count:
        state = g.state["state"]
        out.append((np.asarray(state["key"], "<u4").tobytes(), int(state["pos"]), block, done))
        done += len(picks(g.random_raw(block), n))
    return out


def draws(spark: SparkSession, seed: int, n: int, repetitions: int, block: int = BLOCK) -> DataFrame:
    """repetition, i, pick (each from 0): what ``[rng.choice(range(n)) for _ in range(n)]``, repeated, gives.

    ``n`` is at most 2**32; n = 0 gives no rows.
    """
    schema = "repetition int, i long, pick long"
    if n == 0 or repetitions == 0:
        return spark.createDataFrame([], schema)
    if n >> 32:
        raise ValueError("a draw takes one word of 32 bits")
    made = blocks(seed, n, n * repetitions, block)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, pos, words, before in zip(frame["key"], frame["pos"], frame["words"], frame["before"], strict=True):
                g = np.random.MT19937()
                g.state = {"bit_generator": "MT19937", "state": {"key": np.frombuffer(key, "<u4").astype(np.uint32), "pos": int(pos)}}
                got = picks(g.random_raw(int(words)), n)[: max(0, n * repetitions - before)]
                place = before + np.arange(len(got))
                for i in range(0, len(got), BLOCK):
                    part = slice(i, i + BLOCK)
                    yield pd.DataFrame({"repetition": (place[part] // n).astype(np.int32), "i": place[part] % n, "pick": got[part]})

    return spark.createDataFrame(made, "key binary, pos int, words long, before long").repartition(len(made)).mapInPandas(run, schema)


def sequential_bootstrap(values: DataFrame, value: str, statistic: Column, seed: int, repetitions: int) -> DataFrame:
    """low, high: the central 95 % of ``statistic`` (of the column ``value``) over resamples by the one generator.

    ``values`` is numbered: i from 0 and n, the number of rows (``operators.ordered.numbered``). No rows: nulls.

    Draws and values meet by a shuffle: the plan takes the draws for as small as the states that they are made from, and
    would else collect them, ``repetitions`` times the rows, to broadcast them.
    """
    n = values.agg(F.max("n").alias("n")).first()["n"] or 0
    drawn = draws(values.sparkSession, seed, n, repetitions).select("repetition", F.col("pick").alias("i"))
    samples = drawn.join(values.select("i", value).hint("shuffle_hash"), "i").groupBy("repetition").agg(statistic.alias("s"))
    return samples.agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))


def uniforms(seed: int, start: int, count: int) -> np.ndarray:
    """Numbers ``start`` to ``start + count`` of ``default_rng(seed).random()``."""
    g = np.random.PCG64(seed)
    g.advance(start)
    return np.random.Generator(g).random(count)


def with_uniforms(df: DataFrame, place: str, seed: int, name: str = "u") -> DataFrame:
    """``df`` with the uniform number of each row's ``place`` (from 0) in the one stream; a null place has none."""

    @F.pandas_udf("double")
    def run(at: pd.Series) -> pd.Series:
        out, known = np.full(len(at), np.nan), at.notna().to_numpy()
        places = at[known].to_numpy(np.int64)
        order = np.argsort(places, kind="stable")
        ordered, values = places[order], np.empty(len(places))
        edges = [0, *(np.flatnonzero(np.diff(ordered) > 64) + 1).tolist(), len(ordered)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j > i:  # a run of near places is drawn in one go
                values[i:j] = uniforms(seed, int(ordered[i]), int(ordered[j - 1] - ordered[i]) + 1)[ordered[i:j] - ordered[i]]
        drawn = np.empty(len(places))
        drawn[order] = values
        out[known] = drawn
        return pd.Series(out).mask(~known)

    return df.withColumn(name, F.when(F.col(place).isNotNull(), run(F.col(place).cast("long"))))
