"""Thirty questions about agent traces, each a plan over the canonical tables (see bundle)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import stats
from sparkwright.functions.scalars import exact_mcnemar, ratio, two_sided_p, uniform_hex
from sparkwright.functions.text import has_text, mentioned
from sparkwright.operators.ordered import average_ranks, running
from sparkwright.operators.relational import divided, next_after, orphans, top_with_ties, undominated
from sparkwright.operators.tables import forgotten, written
from sparkwright.plans.bundle import Bundle

NOTEBOOK = r"(?i)notebook_v\d+"


def counted(name: str, value: str) -> Column:
    return F.count_if(F.col("status") == value).alias(name)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def observed_ms() -> Column:
    return ((F.col("end_us") - F.col("start_us")) / 1000).cast("long")


def tools(b: Bundle) -> DataFrame:
    return b.observations.filter("type = 'tool'").withColumn("tool_name", F.regexp_replace("name", "^tool:", ""))


def q01(b: Bundle) -> DataFrame:
    """How many traces, by outcome."""
    total = F.count("*")
    return b.traces.agg(total.alias("total_traces"), counted("success", "success"), counted("error", "error"), (total - F.count_if(F.col("status").isin("success", "error"))).alias("other"))


def q02(b: Bundle) -> DataFrame:
    """Failed traces with turn, duration, kind of error and number of tools."""
    return b.traces.filter("status = 'error'").select("trace_id", "session_id", "turn", "duration_ms", "error_type", "tool_count", "start_us")


def q03(b: Bundle) -> DataFrame:
    """The latest attempt of each session."""
    best = F.max_by(F.struct("trace_id", "turn", "status", "end_us"), F.struct("end_us", "trace_id"))
    return b.traces.groupBy("session_id").agg(best.alias("b")).select("session_id", "b.*")


def q04(b: Bundle) -> DataFrame:
    """The longest trace, all of several."""
    return top_with_ties(b.traces.select("trace_id", "status", "duration_ms", "tool_count", "llm_rounds"), "duration_ms")


def q05(b: Bundle) -> DataFrame:
    """Calls of each tool by outcome."""
    return tools(b).groupBy("tool_name").agg(F.count("*").alias("total"), counted("success", "success"), counted("error", "error"))


def q06(b: Bundle) -> DataFrame:
    """Failed tool calls and how long they took."""
    return tools(b).filter("status = 'error'").select("observation_id", "trace_id", "tool_name", "tool_index", observed_ms().alias("duration_ms"))


def q07(b: Bundle) -> DataFrame:
    """Tokens of each trace, missing ones as 0, and whether it has the most."""
    n = [F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_tokens")]
    t = b.traces.select("trace_id", *n).withColumn("both_tokens", F.col("input_tokens") + F.col("output_tokens"))
    most = t.agg(F.max("both_tokens").alias("most"))
    return t.crossJoin(F.broadcast(most)).withColumn("has_most", F.col("both_tokens") == F.col("most")).drop("most")


def q08(b: Bundle) -> DataFrame:
    """Generations of each trace and the nearest-rank 95th percentile of their duration; null without any."""
    own = Window.partitionBy("trace_id")
    g = b.observations.filter("type = 'generation'").select("trace_id", observed_ms().alias("ms"))
    g = g.select("trace_id", "ms", F.row_number().over(own.orderBy("ms")).alias("r"), F.count("*").over(own).alias("c"))
    p = g.filter(F.col("r") == F.ceil(F.col("c") * 95 / 100)).select("trace_id", "c", F.col("ms").alias("p95_ms"))
    return b.traces.select("trace_id").join(p, "trace_id", "left").select("trace_id", F.coalesce("c", F.lit(0)).alias("generation_count"), "p95_ms")


def q09(b: Bundle) -> DataFrame:
    """The five slowest tool calls."""
    t = tools(b).select("trace_id", "observation_id", "tool_name", "status", observed_ms().alias("duration_ms"))
    return t.orderBy(F.desc("duration_ms"), "trace_id", "observation_id").limit(5)


def q10(b: Bundle) -> DataFrame:
    """Means of successful and failed traces."""
    t = b.traces.filter("status in ('success', 'error')")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0)).cast("double")), 3)
    return t.groupBy("status").agg(F.count("*").alias("trace_count"), mean("duration_ms").alias("mean_duration_ms"), mean("tool_count").alias("mean_tool_count"), mean("input_tokens").alias("mean_input_tokens"), mean("output_tokens").alias("mean_output_tokens"))


def q11(b: Bundle) -> DataFrame:
    """For each failure, the first success of its session that starts strictly after its end."""
    failed = b.traces.filter("status = 'error'").select("trace_id", "session_id", "end_us")
    good = b.traces.filter("status = 'success'").select("session_id", "start_us", F.col("trace_id").alias("success"))
    n = next_after(failed, good, ["session_id"], "end_us", "start_us", ["success"])
    gap = F.round((F.col("next_start_us") - F.col("end_us")) / 1e6, 6)
    return n.select(F.col("trace_id").alias("failed_trace_id"), "session_id", F.col("next_success").isNotNull().alias("found"), F.col("next_success").alias("next_trace_id"), gap.alias("gap_seconds"))


def q12(b: Bundle) -> DataFrame:
    """Each session's attempts in order: statuses and traces."""
    rows = F.array_sort(F.collect_list(F.struct("start_us", "trace_id", "status")))
    return b.traces.groupBy("session_id").agg(rows.alias("r")).select("session_id", F.array_join(F.transform("r", lambda x: x["status"]), ",").alias("status_sequence"), F.array_join(F.transform("r", lambda x: x["trace_id"]), ",").alias("trace_sequence"))


def q13(b: Bundle) -> DataFrame:
    """Whether a trace has output, and its characters."""
    there = has_text(F.col("output"))
    return b.traces.select("trace_id", there.alias("output_available"), F.when(there, F.char_length("output").cast("long")).alias("characters"))


def q14(b: Bundle) -> DataFrame:
    """Notebook versions that a trace and its observations mention."""
    texts = b.traces.select("trace_id", "output").union(b.observations.select("trace_id", "output")).filter("output is not null")
    found = texts.select("trace_id", F.explode(mentioned(F.col("output"), NOTEBOOK)).alias("v")).groupBy("trace_id").agg(F.array_sort(F.collect_set("v")).alias("v"))
    return b.traces.select("trace_id").join(found, "trace_id", "left").select("trace_id", F.coalesce(F.array_join("v", ","), F.lit("")).alias("versions"), F.coalesce(F.size("v"), F.lit(0)).cast("long").alias("version_count"))


def q15(b: Bundle) -> DataFrame:
    """Quality audit: one row for each check with its count."""
    o, t = b.observations, b.traces
    roots = o.filter("parent_id is null").groupBy("trace_id").agg(F.count("*").alias("c"))
    checks = {
        "missing_model": t.filter("model_id is null or model_id = 'unknown'"), "missing_output": t.filter(~has_text(F.col("output"))), "missing_usage": t.filter("input_tokens is null and output_tokens is null"),
        "not_one_root": t.join(roots, "trace_id", "left").filter("coalesce(c, 0) <> 1"), "broken_trace_link": orphans(o, "trace_id", t, "trace_id"), "broken_parent_link": orphans(o, "parent_id", o, "observation_id"),
        "start_after_end": t.select("start_us", "end_us").union(o.select("start_us", "end_us")).filter("start_us > end_us"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def q16(b: Bundle) -> DataFrame:
    """Answers with the lineage problems that they have."""
    roots = b.observations.filter("parent_id is null").groupBy("trace_id").agg(F.count("*").alias("roots"))
    same = b.answers.groupBy("task_id", "model_id", "trace_id").agg(F.count("*").alias("links"))
    known = lambda df, k: df.select(k).distinct().withColumn(f"has_{k}", F.lit(True))
    a = b.answers.join(b.traces.select("trace_id", "session_id", F.lit(True).alias("has_trace")), "trace_id", "left").join(known(b.tasks, "task_id"), "task_id", "left").join(known(b.models, "model_id"), "model_id", "left").join(known(b.sessions, "session_id"), "session_id", "left").join(roots, "trace_id", "left").join(same, ["task_id", "model_id", "trace_id"])
    flag = lambda c, name: F.when(c, F.lit(name))
    issues = F.array_compact(F.array(flag(F.col("roots").isNotNull() & (F.col("roots") != 1) | F.col("roots").isNull(), "ambiguous_root_observation"), flag(F.col("links") > 1, "duplicate_answer_link"), flag(F.col("has_model_id").isNull(), "missing_model"), flag(F.col("has_trace").isNotNull() & F.col("has_session_id").isNull(), "missing_session"), flag(F.col("has_task_id").isNull(), "missing_task"), flag(F.col("has_trace").isNull(), "missing_trace")))
    return a.select("answer_id", F.array_join(issues, ",").alias("issues")).filter("issues <> ''")


def canonical_answers(b: Bundle) -> DataFrame:
    """One graded answer for each task and model: of the last attempt, by end, then by id."""
    a = b.answers.join(b.traces.select("trace_id", "attempt_number", "end_us", "duration_ms", "cost", "status"), "trace_id")
    best = F.max_by(F.struct("answer_id", "trace_id", "correct", "duration_ms", "cost", "status"), F.struct("attempt_number", "end_us", "answer_id"))
    return a.groupBy("task_id", "model_id").agg(best.alias("b")).select("task_id", "model_id", "b.*")


def paired(b: Bundle, value: str, keep: str) -> DataFrame:
    """task_id, x, y of the two selected models where both have a value; written, as it is read several times."""
    x, y = b.config.selected_models
    one = lambda m, name: F.max(F.when(F.col("model_id") == m, F.col(value).cast("double"))).alias(name)
    both = canonical_answers(b).filter(keep).groupBy("task_id").agg(one(x, "x"), one(y, "y")).filter("x is not null and y is not null")
    return written(both, "paired")


def q17(b: Bundle) -> DataFrame:
    """Paired accuracies of two models: difference, interval, McNemar."""
    p = paired(b, "correct", "correct is not null").withColumn("d", F.col("y") - F.col("x"))
    low_high = stats.bootstrap(p.select("task_id", "d"), F.col("task_id"), stats.mean_of(F.col("d")), b.config.bootstrap_repetitions, b.config.seed)
    n = p.agg(F.count("*").alias("pairs"), r6(F.avg("x")).alias("accuracy_a"), r6(F.avg("y")).alias("accuracy_b"), r6(F.avg("d")).alias("difference"), F.count_if(F.expr("x > y")).alias("only_a"), F.count_if(F.expr("y > x")).alias("only_b"))
    return n.crossJoin(low_high).select("pairs", "accuracy_a", "accuracy_b", "difference", "only_a", "only_b", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), r6(exact_mcnemar(F.col("only_a"), F.col("only_b"))).alias("mcnemar_p"))


def q18(b: Bundle) -> DataFrame:
    """Paired latencies of successful traces: median difference and interval."""
    p = paired(b, "duration_ms", "status = 'success'").withColumn("d", F.col("y") - F.col("x"))
    low_high = stats.bootstrap(p.select("task_id", "d"), F.col("task_id"), F.percentile("d", F.lit(0.5), F.col("w")), b.config.bootstrap_repetitions, b.config.seed)
    return p.agg(F.count("*").alias("pairs"), r6(F.median("d")).alias("median_difference_ms")).crossJoin(low_high.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high")))


def q19(b: Bundle) -> DataFrame:
    """Accuracy, cost and latency on tasks that every model tried, and who is on the frontier."""
    c = written(canonical_answers(b), "canonical")
    common = divided(c, "task_id", "model_id")
    n = common.agg(F.count("*").alias("tasks"))
    m = c.join(common, "task_id", "left_semi").groupBy("model_id").agg(F.count("correct").alias("graded"), F.count_if(F.expr("cost is not null and duration_ms is not null")).alias("whole"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("cost").alias("cost"), F.avg("duration_ms").alias("latency")).crossJoin(F.broadcast(n))
    able = m.withColumn("eligible", (F.col("graded") == F.col("tasks")) & (F.col("whole") == F.col("tasks")))
    front = undominated(able.filter("eligible"), "model_id", ["accuracy"], ["cost", "latency"]).select("model_id", F.lit(True).alias("f"))
    return able.join(front, "model_id", "left").select("model_id", "graded", "whole", "tasks", "eligible", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("cost")).alias("cost"), r6(F.col("latency")).alias("latency"), F.coalesce("f", F.lit(False)).alias("on_frontier"))


def q20(b: Bundle) -> DataFrame:
    """Whether one model's lead is larger on hard tasks than on easy ones, with an interval by strata."""
    p = paired(b, "correct", "correct is not null").withColumn("d", F.col("y") - F.col("x")).join(b.tasks.select("task_id", "difficulty"), "task_id").filter("difficulty in ('easy', 'hard')")
    part = lambda x, name: F.when(F.col("difficulty") == name, x)
    gap = F.avg(part(F.col("d"), "hard")) - F.avg(part(F.col("d"), "easy"))
    again = stats.mean_of(part(F.col("d"), "hard")) - stats.mean_of(part(F.col("d"), "easy"))
    low_high = stats.bootstrap(p.select("task_id", "difficulty", "d"), F.col("task_id"), again, b.config.bootstrap_repetitions, b.config.seed)
    return p.agg(F.count("*").alias("tasks"), r6(gap).alias("interaction")).crossJoin(low_high.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high")))


def depths(observations: DataFrame) -> DataFrame:
    """observation_id, trace_id, depth: 1 for a root, one more for each parent; a walk ends at a repeated or absent parent.

    Of an id that repeats, the smallest parent counts. Pointers are doubled (see ``ends``); walks into a cycle have as many
    steps as stand before it, and the cycle's length.
    """
    up = observations.groupBy(F.col("observation_id").alias("id")).agg(F.min("parent_id").alias("to"))
    walks, left = ends(up)
    done = walks.filter("to is null").select("id", F.col("steps").alias("depth"))
    if left:
        inside = up.join(walks.filter("to is not null").select("id"), "id", "left_semi")
        rings = cycles(inside)
        size = rings.groupBy("ring").agg(F.count("*").alias("size"))
        on = written(rings.join(size, "ring").select("id", "size"), "cycles")
        before, _ = ends(inside.join(on, "id", "left_anti"))  # a parent on a cycle is absent there, so it ends the walk
        done = done.union(on.select("id", F.col("size").alias("depth"))).union(before.join(on.select(F.col("id").alias("last"), "size"), "last").select("id", (F.col("steps") - 1 + F.col("size")).alias("depth")))
    return observations.select(F.col("observation_id").alias("id"), "trace_id").join(done, "id").select(F.col("id").alias("observation_id"), "trace_id", (F.col("depth") + 1).alias("depth"))


def ends(up: DataFrame) -> tuple[DataFrame, int]:
    """For each id of ``up`` (id, to): to (null: the walk has ended), steps (taken so far), last (the place reached); and how many go on.

    Each round joins a walk with that of the place it has reached, so rounds grow with the logarithm of the longest walk.
    If there is one of more than 2^k steps, there is one of each smaller number (those of the places it passes); so once a
    round ends no walk, all that go on run into cycles.
    """
    one = F.col("to").isNotNull().cast("long")
    walks = written(up.select("id", "to", one.alias("steps"), F.coalesce("to", "id").alias("last")), "walks")
    left = walks.filter("to is not null").count()
    while left:
        of = walks.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("last").alias("end"))
        step = walks.join(of, "to", "left").select("id", F.col("next").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("end", "last").alias("last"))
        new = written(step, "walks")
        forgotten(walks)
        walks, was, left = new, left, new.filter("to is not null").count()
        if left == was:
            break
    return walks, left


def cycles(inside: DataFrame) -> DataFrame:
    """id, ring (its cycle's smallest id) of the members of cycles among ``inside`` (id, to), all of whose walks go on for ever."""
    at, passed = written(inside.select("id", "to", F.col("id").alias("low")), "rings"), 1
    whole = at.count()
    while passed < whole:
        of = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("other"))
        new = written(at.join(of, "to").select("id", F.col("next").alias("to"), F.least("low", "other").alias("low")), "rings")
        forgotten(at)
        at, passed = new, 2 * passed
    return at.join(at.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("ring"))


def complexity(b: Bundle) -> DataFrame:
    """trace_id, complexity: largest depth + tool calls + generations."""
    d = depths(b.observations).groupBy("trace_id").agg(F.max("depth").alias("deep"))
    n = b.observations.groupBy("trace_id").agg(F.count_if(F.col("type").isin("tool", "generation")).alias("c"))
    return b.traces.select("trace_id").join(d, "trace_id", "left").join(n, "trace_id", "left").select("trace_id", (F.coalesce("deep", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("complexity"))


def q21(b: Bundle) -> DataFrame:
    """Rank correlation of complexity and correctness, with a permutation test within tasks.

    A repetition deals each task's ranks anew, by hashes of its models; only the sum of products changes, so each task
    gives one number for each repetition. Hashes are compared as the hex texts that they are.
    """
    c = canonical_answers(b).filter("correct is not null").join(complexity(b), "trace_id").select("task_id", "model_id", F.col("complexity").cast("double").alias("x"), F.col("correct").cast("double").alias("y"))
    ranked = written(average_ranks(written(c, "answers"), {"rx": F.col("x"), "ry": F.col("y")}).select("task_id", "model_id", "rx", "ry"), "ranked")
    xy = F.col("rx") * F.col("ry")
    rho = ranked.agg(F.count("*").alias("answers"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.avg(xy).alias("mxy"))
    corr = lambda mxy: F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(mxy - F.col("mx") * F.col("my"), F.col("sx") * F.col("sy")))
    tasks = ranked.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("model_id", "rx", "ry"))).alias("of"))  # as many as there are models
    vary = lambda rank: F.array_min(f"of.{rank}") < F.array_max(f"of.{rank}")
    tasks = written(tasks.withColumn("moves", vary("rx") & vary("ry")), "tasks")
    # where all x or all y of a task are equal, no order changes the sum
    still = tasks.filter("not moves").agg(F.sum(F.aggregate("of", F.lit(0.0), lambda a, s: a + s["rx"] * s["ry"])).alias("still"))
    reps = tasks.filter("moves").select("task_id", F.col("of.model_id").alias("models"), F.col("of.rx").alias("rx"), F.col("of.ry").alias("ry"), F.explode(F.sequence(F.lit(0), F.lit(b.config.permutation_repetitions - 1))).alias("rep"))
    reps = reps.withColumn("drawn", F.sort_array(F.zip_with("models", "ry", lambda m, y: F.struct(uniform_hex(F.lit(str(b.config.seed)), F.col("rep"), F.col("task_id"), m).alias("u"), m.alias("model_id"), y.alias("ry")))))
    products = F.aggregate(F.zip_with("rx", "drawn", lambda x, d: x * d["ry"]), F.lit(0.0), lambda a, p: a + p)
    sums = reps.groupBy("rep").agg(F.sum(products).alias("moved"))
    every = ranked.sparkSession.range(b.config.permutation_repetitions).select(F.col("id").cast("int").alias("rep")).join(sums, "rep", "left").crossJoin(F.broadcast(still))
    each = every.select("rep", (F.coalesce("moved", F.lit(0.0)) + F.coalesce("still", F.lit(0.0))).alias("sum")).crossJoin(F.broadcast(rho.filter("answers > 0")))
    far = F.abs(corr(F.col("sum") / F.col("answers"))) >= F.abs(corr(F.col("mxy"))) - 1e-12
    return each.groupBy("answers", corr(F.col("mxy")).alias("rho")).agg(F.count_if(far).alias("as_far"), F.count("*").alias("reps")).select("answers", r6(F.col("rho")).alias("rho"), r6((F.col("as_far") + 1) / (F.col("reps") + 1)).alias("p"))


def q22(b: Bundle) -> DataFrame:
    """Failed tools against failed traces: 2x2 table, risk ratio, interval, Fisher's test."""
    bad = b.observations.filter("type = 'tool' and status <> 'success'").select("trace_id").distinct().withColumn("t", F.lit(True))
    x = b.traces.join(bad, "trace_id", "left").select(F.coalesce("t", F.lit(False)).alias("t"), (F.col("status") != "success").alias("f"))
    n = x.agg(F.count_if(F.expr("t and f")).alias("a"), F.count_if(F.expr("t and not f")).alias("b"), F.count_if(F.expr("not t and f")).alias("c"), F.count_if(F.expr("not t and not f")).alias("d"))
    n = stats.fisher_two_sided(n)
    h = F.when((F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0), 0.5).otherwise(0.0)
    a, bb, c, d = (F.col(k) + h for k in "abcd")
    rr, se = ratio(a, a + bb) / ratio(c, c + d), F.sqrt(1 / a - 1 / (a + bb) + 1 / c - 1 / (c + d))
    return n.select("a", "b", "c", "d", r6(rr).alias("risk_ratio"), r6(F.exp(F.log(rr) - 1.96 * se)).alias("low"), r6(F.exp(F.log(rr) + 1.96 * se)).alias("high"), r6(F.col("p")).alias("fisher_p"))


def q23(b: Bundle) -> DataFrame:
    """Sessions with a failure by number of retries: recovered ones, and the trend's z."""
    w = Window.partitionBy("session_id").orderBy("attempt_number", "start_us", "trace_id")
    r = b.traces.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("session_id"))).withColumn("first", F.min(F.when(F.col("status") != "success", F.col("i"))).over(Window.partitionBy("session_id")))
    u = r.filter("first is not null").groupBy("session_id").agg((F.max("n") - F.max("first")).alias("retries"), F.max(((F.col("i") > F.col("first")) & (F.col("status") == "success")).cast("int")).alias("recovered"))
    by = u.groupBy("retries").agg(F.count("*").alias("n"), F.sum("recovered").alias("r"))
    all_ = Window.partitionBy()
    p, mean = F.sum("r").over(all_) / F.sum("n").over(all_), F.sum(F.col("n") * F.col("retries")).over(all_) / F.sum("n").over(all_)
    t = by.withColumns({"p": p, "m": mean})
    top, low = F.sum(F.col("retries") * (F.col("r") - F.col("n") * F.col("p"))).over(all_), F.sum(F.col("n") * F.pow(F.col("retries") - F.col("m"), 2)).over(all_)
    return t.select(F.col("retries").alias("retry_count"), F.col("n").alias("sessions"), F.col("r").alias("recovered"), r6(F.try_divide(top, F.sqrt(F.col("p") * (1 - F.col("p")) * low))).alias("trend_z"))


def drawn_by(counts: DataFrame, name: str, n: str, rows: DataFrame, ident: Column, repetitions: int, seed: int) -> DataFrame:
    """rep, ``name``, ``n``: how many of a resample's draws fall on each name; a resample draws as many as there are ``rows``.

    ``counts`` (name, n) is a written table whose counts add up to the number of rows. A draw is floor(u * all), u the uniform
    number of seed, rep and ``ident``; the names lie one after the other along it, so each has a range of u. Ranges and draws
    meet as the hex texts that u is made of: by the first digits, then by order, so a draw meets a few names however many
    there are, and is neither made a number nor shuffled, only counted, where the ranges are few.
    """
    digits = min(12, max(3, math.ceil(math.log(4 * counts.count() + 1, 16))))
    ends = running(counts, [F.asc_nulls_last(name)], {"end": F.col(n)}, "__no").crossJoin(F.broadcast(counts.agg(F.sum(n).cast("double").alias("all"))))
    unit, whole = F.lit(float(1 << 52)), F.lit(1 << 52)

    def first(at: Column) -> Column:
        """The smallest number of 13 hex digits whose draw is ``at`` or more; rounding may move it by a few."""
        near = F.ceil(at * unit / F.col("all")).cast("long")
        near = F.sequence(F.greatest(near - 4, F.lit(0).cast("long")), near + 4)
        return F.least(whole, F.array_min(F.filter(near, lambda m: F.floor(m.cast("double") / unit * F.col("all")) >= at)))

    hexed = lambda m, width: F.lower(F.lpad(F.hex(m), width, "0"))
    ranges = ends.select(name, first(F.col("end") - F.col(n)).alias("low"), F.when(F.col("end") < F.col("all"), first(F.col("end"))).otherwise(whole).alias("high"))
    shift = 4 * (13 - digits)
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    blocks = written(blocks.select(name, hexed(F.col("block"), digits).alias("block"), hexed(F.col("low"), 13).alias("low"), hexed(F.col("high") - 1, 13).alias("high")), "ranges")
    draws = rows.select(ident.cast("string").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    draws = draws.select("rep", uniform_hex(F.lit(str(seed)), F.col("rep"), F.col("id")).alias("u")).withColumn("block", F.substring("u", 1, digits))
    return draws.join(blocks, "block").filter(F.col("u").between(F.col("low"), F.col("high"))).groupBy("rep", name).agg(F.count("*").alias(n))


def q24(b: Bundle) -> DataFrame:
    """How failures concentrate on tools: a row for all (HHI and Gini with their intervals) and one for each tool (failures, share).

    A resample draws as many failures as there are, with replacement, by hashes.
    """
    f = tools(b).filter("status <> 'success'").select("observation_id", "tool_name")
    counts = written(f.groupBy("tool_name").agg(F.count("*").alias("failures")), "failures")
    total = counts.agg(F.sum("failures").alias("all"))
    again = drawn_by(counts, "tool_name", "failures", f, F.col("observation_id"), b.config.bootstrap_repetitions, b.config.seed)
    low_high = stats.concentration(again, "failures", "rep").agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("hhi", "gini") for name, q in (("low", 0.025), ("high", 0.975))])
    whole = stats.concentration(counts, "failures").crossJoin(counts.agg(F.sum("failures").alias("failures"))).crossJoin(low_high)
    none = F.lit(None).cast("double")
    rows = whole.select(F.lit("all").alias("tool"), "failures", F.lit(1.0).alias("share"), *[r6(F.col(c)).alias(c) for c in ("hhi", "hhi_low", "hhi_high", "gini", "gini_low", "gini_high")])
    return rows.union(counts.crossJoin(F.broadcast(total)).select("tool_name", "failures", r6(F.col("failures") / F.col("all")), *[none] * 6))


def q25(b: Bundle) -> DataFrame:
    """The split in time at which success rate or latency changes most, by Bonferroni-adjusted p."""
    m = b.config.minimum_window
    t = b.traces.select("trace_id", "start_us", (F.col("status") == "success").cast("long").alias("ok"), F.col("duration_ms").alias("ms"))
    sums = running(t, ["start_us", "trace_id"], {"k": F.col("ok"), "x": F.col("ms"), "xx": F.col("ms") * F.col("ms")})
    n = t.agg(F.count("*").alias("n"), F.sum("ok").alias("all_k"), F.sum("ms").alias("all_x"), F.sum(F.col("ms") * F.col("ms")).alias("all_xx"))
    r = sums.crossJoin(F.broadcast(n)).filter((F.col("s") >= m) & (F.col("s") <= F.col("n") - m))
    s, rest = F.col("s").cast("double"), (F.col("n") - F.col("s")).cast("double")
    p = F.col("all_k") / F.col("n")
    z1 = F.try_divide(F.col("k") / s - (F.col("all_k") - F.col("k")) / rest, F.sqrt(p * (1 - p) * (1 / s + 1 / rest)))
    var = lambda x, xx, c: F.greatest(F.lit(0.0), (xx - x * x / c) / (c - 1))
    v1, v2 = var(F.col("x").cast("double"), F.col("xx").cast("double"), s), var((F.col("all_x") - F.col("x")).cast("double"), (F.col("all_xx") - F.col("xx")).cast("double"), rest)
    z2 = F.try_divide(F.col("x") / s - (F.col("all_x") - F.col("x")) / rest, F.sqrt(v1 / s + v2 / rest))
    splits = r.withColumn("m", F.explode(F.array(F.struct(F.lit("latency").alias("metric"), z2.alias("z")), F.struct(F.lit("success").alias("metric"), z1.alias("z")))))
    best = splits.agg(F.max_by(F.struct("s", "m.metric", "m.z"), F.struct(F.round(F.abs(F.coalesce(F.col("m.z"), F.lit(0.0))), 9), -F.col("s"))).alias("b"), F.count("*").alias("tests"))
    return best.select(F.col("b.s").alias("split"), F.col("b.metric").alias("metric"), r6(F.col("b.z")).alias("z"), r6(F.least(F.lit(1.0), F.col("tests") * two_sided_p(F.col("b.z")))).alias("p"))


def annotation_issues(b: Bundle) -> DataFrame:
    """annotation_id and its reasons, for annotations that have any."""
    a = b.annotations
    prior = a.select(F.col("annotation_id").alias("supersedes"), F.struct("target_type", "target_id", "annotator_id", "schema_version", "labeled_us").alias("was"))
    asked = a.select("target_type", "target_id").distinct()  # few, so that the large tables are filtered where they lie
    one = lambda df, k, t, of: df.select(F.col(k).alias("target_id"), F.lit(t).alias("target_type"), F.lit(True).alias("there"), of.cast("string").alias("of_trace"))
    none = F.lit(None)
    every = one(b.traces, "trace_id", "trace", none).union(one(b.observations, "observation_id", "observation", F.col("trace_id"))).union(one(b.sessions, "session_id", "session", none))
    targets = every.join(asked, ["target_type", "target_id"], "left_semi").dropDuplicates(["target_type", "target_id"])
    twice = a.groupBy("annotation_id").agg(F.count("*").alias("copies"))
    x = a.join(twice, "annotation_id").join(targets, ["target_type", "target_id"], "left").join(prior.dropDuplicates(["supersedes"]), "supersedes", "left").join(revision_cycles(a), "annotation_id", "left")
    t = F.col("target_type")
    rules = [
        ("duplicate_annotation_id", F.col("copies") > 1), ("missing_trace_target", (t == "trace") & F.col("there").isNull()), ("missing_observation_target", (t == "observation") & F.col("there").isNull()), ("missing_session_target", (t == "session") & F.col("there").isNull()),
        ("invalid_target_type", ~t.isin("trace", "observation", "session")), ("trace_target_mismatch", (t == "trace") & (F.col("trace_id") != F.col("target_id"))), ("trace_observation_mismatch", (t == "observation") & (F.col("of_trace") != F.col("trace_id"))), ("session_target_has_trace_id", (t == "session") & F.col("trace_id").isNotNull()),
        ("missing_annotator_id", F.col("annotator_id").isNull() | (F.col("annotator_id") == "")), ("invalid_annotator_type", ~F.coalesce(F.col("annotator_type").isin("human", "llm", "rule", "imported"), F.lit(False))), ("missing_label_schema_version", F.col("schema_version").isNull()), ("missing_source", F.col("source").isNull()),
        ("invalid_retracted_flag", F.col("retracted").isNull()), ("invalid_confidence", ~F.col("confidence").between(0, 1)), ("ingested_before_labeled", F.col("ingested_us") < F.col("labeled_us")), ("invalid_timestamp", F.col("ingested_us").isNull() | F.col("labeled_us").isNull()),
        ("missing_predecessor", F.col("supersedes").isNotNull() & F.col("was").isNull()), ("revision_not_later", F.col("labeled_us") <= F.col("was.labeled_us")), ("revision_cycle", F.coalesce("cycle", F.lit(False))),
        *[(f"revision_changes:{c}", F.col("was").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"was.{c}"))) for c in ("target_type", "target_id", "annotator_id", "schema_version")],
    ]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules])))
    return x.select("annotation_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def revision_cycles(a: DataFrame) -> DataFrame:
    """annotation_id, cycle (true) of annotations whose chain of predecessors comes back to them (of an id that repeats, the smallest predecessor's).

    Whatever supersedes nothing that itself supersedes something is on no cycle; mostly that leaves nothing to walk.
    """
    step = a.filter("supersedes is not null").groupBy(F.col("annotation_id").alias("id")).agg(F.min("supersedes").alias("to"))
    live = written(step.join(step.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"), "revisions")
    if not live.limit(1).count():
        return live.select(F.col("id").alias("annotation_id"), F.lit(True).alias("cycle"))
    walks, left = ends(live)
    rings = cycles(live.join(walks.filter("to is not null").select("id"), "id", "left_semi")) if left else live.limit(0)
    return rings.select(F.col("id").alias("annotation_id"), F.lit(True).alias("cycle"))


def q26(b: Bundle) -> DataFrame:
    """How many annotations have each problem."""
    return annotation_issues(b).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def effective(b: Bundle) -> DataFrame:
    """The valid annotation that stands for each target, annotator and schema: one head, no branch, not retracted."""
    bad = annotation_issues(b).select("annotation_id").distinct()
    ok = b.annotations.join(bad, "annotation_id", "left_anti")
    group = ["target_type", "target_id", "annotator_id", "schema_version"]
    children = ok.filter("supersedes is not null").groupBy(*group, "supersedes").agg(F.count("*").alias("c"))
    branched = children.filter("c > 1").select(*group).distinct()
    heads = ok.join(children.select(*group, F.col("supersedes").alias("annotation_id")), [*group, "annotation_id"], "left_anti")
    single = heads.withColumn("heads", F.count("*").over(Window.partitionBy(*group))).filter("heads = 1 and not retracted")
    return single.join(branched, group, "left_anti").drop("heads")


def q27(b: Bundle) -> DataFrame:
    """Effective labels."""
    return effective(b).select("target_type", "target_id", "annotator_id", "annotation_id", "label")


def label_pairs(b: Bundle) -> DataFrame:
    """Two annotators' labels of one target (first the smaller id), with the target's task family."""
    e = effective(b).filter("label is not null")
    last = written(e.groupBy("target_type", "target_id", "annotator_id").agg(F.max_by("label", F.struct("labeled_us", "annotation_id")).alias("label")), "labels")
    a, o = last.select("target_type", "target_id", F.col("annotator_id").alias("left"), F.col("label").alias("x")), last.select("target_type", "target_id", F.col("annotator_id").alias("right"), F.col("label").alias("y"))
    asked = last.select("target_id").distinct()
    trace = b.observations.filter("trace_id is not null").select(F.col("observation_id").alias("target_id"), "trace_id").join(asked, "target_id", "left_semi").join(b.traces.select("trace_id", "task_id"), "trace_id").select("target_id", "task_id")
    trace = trace.union(b.traces.select(F.col("trace_id").alias("target_id"), "task_id").join(asked, "target_id", "left_semi"))
    family = trace.join(b.tasks, "task_id", "left").select("target_id", F.coalesce("task_family", "difficulty", F.lit("unknown")).alias("category")).dropDuplicates(["target_id"])
    return a.join(o, ["target_type", "target_id"]).filter("left < right").join(family, "target_id", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("px"), F.avg(y).alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return s.select(*keys, "pairs", r6(F.col("po")).alias("agreement"), r6(F.when(pe < 1, (F.col("po") - pe) / (1 - pe))).alias("kappa"))


def q28(b: Bundle) -> DataFrame:
    """Agreement and Cohen's kappa of annotator pairs, overall and by task family."""
    p = label_pairs(b)
    both = p.withColumn("category", F.explode(F.array(F.lit("all"), F.col("category"))))
    return agreement(both, "left", "right", "category")


def q29(b: Bundle) -> DataFrame:
    """Whether one annotator says yes more often than another: McNemar with Holm's adjustment."""
    s = label_pairs(b).groupBy("left", "right").agg(F.count("*").alias("pairs"), F.avg(F.col("x").cast("double")).alias("px"), F.avg(F.col("y").cast("double")).alias("py"), F.count_if(F.expr("x and not y")).alias("only_left"), F.count_if(F.expr("y and not x")).alias("only_right"))
    h = stats.holm(s.withColumn("p", exact_mcnemar(F.col("only_left"), F.col("only_right"))))
    return h.select("left", "right", "pairs", r6(F.col("px")).alias("left_rate"), r6(F.col("py")).alias("right_rate"), "only_left", "only_right", r6(F.col("p")).alias("p"), r6(F.col("holm_p")).alias("holm_p"))


def q30(b: Bundle) -> DataFrame:
    """Delay from label to ingest, and how revisions change labels."""
    a = b.annotations.filter("labeled_us is not null and ingested_us is not null")
    word = lambda c: F.coalesce(F.initcap(c.cast("string")), F.lit("None"))
    prior = a.select(F.col("annotation_id").alias("supersedes"), F.col("label").alias("old"))
    moves = a.filter("supersedes is not null").join(prior, "supersedes").select(F.concat(word(F.col("old")), F.lit("->"), F.when(F.col("retracted"), "RETRACTED").otherwise(word(F.col("label")))).alias("k"))
    seconds = (F.col("ingested_us") - F.col("labeled_us")) / 1e6
    delay = a.agg(F.lit("delay").alias("k"), F.count("*").alias("n"), r6(F.median(seconds)).alias("median_s"), r6(F.percentile(seconds, F.lit(0.95))).alias("p95_s"))
    none = F.lit(None).cast("double")
    return delay.union(moves.groupBy("k").agg(F.count("*").alias("n"), none.alias("median_s"), none.alias("p95_s")))


ALL = {f.__name__: f for f in (q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22, q23, q24, q25, q26, q27, q28, q29, q30)}
