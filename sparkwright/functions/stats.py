"""Statistics as DataFrame steps: resampling, exact tests, agreement, adjustment, concentration, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.scalars import log_factorial, uniform
from sparkwright.operators.ordered import average_ranks, running


def resampled(values: DataFrame, repetitions: int, seed: int, salt: str = "") -> DataFrame:
    """rep and the rows of ``values`` (i, n, ...) drawn with replacement, n for each repetition."""
    draws = values.select("i", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    draws = draws.select("rep", F.floor(uniform(F.lit(f"{seed}{salt}"), F.col("rep"), F.col("i")) * F.col("n")).cast("int").alias("i"))
    return draws.join(values.drop("n"), "i")


def interval(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The 2.5 and 97.5 percentiles, linearly interpolated."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def poisson_steps(bits: int = 32) -> list[str]:
    """The numbers of ``bits`` bits, as hex text, below which a Poisson number of mean 1 is 0, 1, 2 and so on."""
    share, term, out = 0.0, math.exp(-1), []
    while share + term < 1 and math.floor((share + term) * (1 << bits)) < (1 << bits) - 1:
        share += term
        out.append(f"{math.floor(share * (1 << bits)):0{bits // 4}x}")
        term /= len(out)
    return out


def weighted(rows: DataFrame, ident: Column, repetitions: int, seed: int) -> DataFrame:
    """``rows`` with rep and w > 0: how often a resample takes the row, a Poisson number that seed, rep and ``ident`` fix.

    Each row makes its numbers where it lies, four from one MD5, so sums by rep need no row to meet another, and partial
    sums are all that is shuffled. A resample's size is about, not exactly, that of ``rows``.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((repetitions - 1) // 4))).alias("__block")
    drawn = rows.withColumn("__ident", ident.cast("string")).select("*", blocks).withColumn("__digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__block").cast("string"), "__ident")))
    parts = F.explode(F.array(*[F.struct((F.col("__block") * 4 + k).alias("rep"), F.substring("__digest", 8 * k + 1, 8).alias("h")) for k in range(4)])).alias("__part")
    w, steps = None, poisson_steps()
    for n, step in enumerate(steps):
        w = F.when(F.col("__part.h") < step, n) if w is None else w.when(F.col("__part.h") < step, n)
    return drawn.select(*rows.columns, parts).select(*rows.columns, F.col("__part.rep").alias("rep"), w.otherwise(len(steps)).alias("w")).filter((F.col("w") > 0) & (F.col("rep") < repetitions))


def bootstrap(rows: DataFrame, ident: Column, stat: Column, repetitions: int, seed: int) -> DataFrame:
    """low, high of ``stat`` (an aggregate in which a row counts w times) over Poisson resamples of ``rows``."""
    return interval(weighted(rows, ident, repetitions, seed).groupBy("rep").agg(stat.alias("s")), "s")


def mean_of(value: Column) -> Column:
    """The mean of ``value`` in a resample, for ``bootstrap``; rows where it is null count for nothing."""
    return F.try_divide(F.sum(value * F.col("w")), F.sum(F.when(value.isNotNull(), F.col("w"))))


def fisher_two_sided(table: DataFrame) -> DataFrame:
    """``table`` (a, b, c, d in one row) with p: the total probability of tables that are not likelier.

    Tables farther than 40 standard deviations from the likeliest have no weight and are not made; each of the others is
    weighed by itself, from factorials, so sums are all that meets.
    """
    row, col, n = (F.col("a") + F.col("b")).cast("double"), (F.col("a") + F.col("c")).cast("double"), (F.col("a") + F.col("b") + F.col("c") + F.col("d")).cast("double")
    low, high = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)
    middle = F.floor((row + 1) * (col + 1) / (n + 2))
    reach = F.ceil(40 * F.sqrt(row * col * (n - row) * (n - col) / F.greatest(n * n * (n - 1), F.lit(1.0)))) + 2
    weigh = lambda x: -(log_factorial(x) + log_factorial(F.col("__row") - x) + log_factorial(F.col("__col") - x) + log_factorial(F.col("__n") - F.col("__row") - F.col("__col") + x))
    whole = table.withColumns({"__row": row, "__col": col, "__n": n, "__low": F.greatest(low, middle - reach), "__high": F.least(high, middle + reach)})
    # the weights of tables that are equally likely may differ by rounding, in proportion to the factorials' logarithms
    whole = whole.withColumns({"__seen": weigh(F.col("a").cast("double")), "__top": weigh(F.greatest(F.least(F.floor((row + 1) * (col + 1) / (n + 2)).cast("double"), high), low)), "__near": F.greatest(F.lit(1e-9), 1e-14 * log_factorial(n))})
    rows = whole.withColumn("__x", F.explode(F.sequence(F.col("__low").cast("long"), F.col("__high").cast("long")))).withColumn("__l", weigh(F.col("__x").cast("double")))
    chance = F.exp(F.col("__l") - F.col("__top"))
    rare = F.when(F.col("__l") <= F.col("__seen") + F.col("__near"), chance).otherwise(0.0)
    return rows.groupBy("a", "b", "c", "d").agg(F.least(F.lit(1.0), F.sum(rare) / F.sum(chance)).alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return average_ranks(df.select(x, y), {"rx": F.col(x), "ry": F.col(y)}).agg(guarded_corr("rx", "ry").alias("rho"))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's r; null where a side does not vary."""
    vary = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    sxy = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    return F.when(vary, F.try_divide(sxy, F.stddev_pop(x) * F.stddev_pop(y)))


def holm(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with holm_p: the running maximum of (m - rank) * p; for the few rows of a result."""
    order = Window.orderBy(p, *[c for c in df.columns if c != p])
    scaled = df.withColumn("__s", F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col(p)))
    return scaled.withColumn("holm_p", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def concentration(counts: DataFrame, n: str, *keys: str) -> DataFrame:
    """hhi and gini of the positive counts (by ``keys``); the counts of one key are few."""
    own = Window.partitionBy(*keys)
    ranked = counts.withColumn("r", F.row_number().over(own.orderBy(n))).withColumn("t", F.sum(n).over(own))
    m, t = F.count("*"), F.max("t")
    return ranked.groupBy(*keys).agg(F.sum(F.pow(F.col(n) / F.col("t"), 2)).alias("hhi"), (2 * F.sum(F.col("r") * F.col(n)) / (m * t) - (m + 1) / m).alias("gini"))


def regression_metrics(y: str, p: str) -> list[Column]:
    e = F.col(p) - F.col(y)
    sst = F.sum(F.pow(F.col(y), 2)) - F.pow(F.sum(y), 2) / F.count(y)
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"), F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(F.col(y)))).alias("wape"), F.avg(e).alias("bias")]


def classification_metrics(y: Column, p: Column) -> list[Column]:
    tp, fp, fn, tn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p), F.count_if(~y & ~p)
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), safe(tp + tn, F.count("*")).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy")]


def ranking_metrics(df: DataFrame, y: str, score: str, *keys: str) -> DataFrame:
    """roc_auc (null with one class), average_precision and brier (by ``keys``), by running sums over the distinct scores.

    One order serves all keys: what stands before a key's first score is subtracted.
    """
    by = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("c"))
    all_ = df.groupBy(*keys).agg(F.sum(F.col(y).cast("long")).alias("yes"), F.sum(1 - F.col(y).cast("long")).alias("no"), F.avg(F.pow(F.col(score) - F.col(y).cast("double"), 2)).alias("brier"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # a row a key
    if keys:
        all_ = all_.withColumns({"p0": F.coalesce(F.sum("yes").over(before), F.lit(0)), "c0": F.coalesce(F.sum(F.col("yes") + F.col("no")).over(before), F.lit(0))})
    else:
        all_ = all_.withColumns({"p0": F.lit(0), "c0": F.lit(0)})
    run = running(by, [*keys, F.desc(score)], {"tp": F.col("p"), "all": F.col("c")})
    run = run.join(all_, list(keys)) if keys else run.crossJoin(F.broadcast(all_))
    tp, seen = F.col("tp") - F.col("p0"), F.col("all") - F.col("c0")
    below = F.col("no") - (seen - tp)
    return run.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * (below + (F.col("c") - F.col("p")) / 2)), F.max(F.col("yes") * F.col("no"))).alias("roc_auc"), F.sum(F.try_divide(F.col("p"), F.col("yes")) * tp / seen).alias("average_precision"), F.max("brier").alias("brier"))


def robust(df: DataFrame, keys: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """n, median and scale (1.4826 * MAD, at least ``floor``) by key."""
    own = df.select(*keys, F.col(value).alias("__v"))
    mid = own.groupBy(*keys).agg(F.count("__v").alias("n"), F.median("__v").alias("median"))
    off = own.join(mid, keys).groupBy(*keys, "n", "median").agg(F.median(F.abs(F.col("__v") - F.col("median"))).alias("__mad"))
    return off.select(*keys, "n", "median", F.greatest(F.lit(floor), 1.4826 * F.col("__mad")).alias("scale"))
