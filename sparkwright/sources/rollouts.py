"""Rollout files (JSON lines of one session each) to turns, answers and the canonical tables.

A turn starts at its marker and ends at the next completion; a new start before that leaves it incomplete. Rows before
the first start and between a completion and the next start belong to no turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions.text import matches_any, short_id
from sparkwright.sources.logs import FAILURE, ROLLOUT, message_text, shown

#: A user message that starts so is none of the user's (fixed value of the format).
PLUGINS = "<recommended_plugins>"
P = F.col


def is_start() -> Column:
    return F.coalesce((P("type") == "event_msg") & (P("payload.type") == "task_started"), F.lit(False))


def is_done() -> Column:
    return F.coalesce((P("type") == "event_msg") & (P("payload.type") == "task_complete"), F.lit(False))


def rank() -> Column:
    """Rows of one time: a start is before, a completion after the others."""
    return F.when(is_start(), 0).when(is_done(), 2).otherwise(1)


def rollout_events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of rollout files with session_id (what the file says, or else its name); raises for a file of a subagent."""
    rows = spark.read.schema(ROLLOUT).json(path).withColumn("file", F.input_file_name())
    meta = rows.filter("type = 'session_meta'")
    sub = meta.filter((P("payload.thread_source") == "subagent") | P("payload.source").startswith("{")).select("file").limit(1).collect()
    if sub:
        raise ValueError(f"a subagent's rollout is no primary log: {sub[0]['file']}")
    named = meta.groupBy("file").agg(F.min_by("payload.id", "timestamp").alias("own"))
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.join(named, "file", "left").select(F.coalesce("own", stem).alias("session_id"), "timestamp", "type", "payload")


def in_turns(events: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """``events`` (session_id, timestamp, type, payload) that belong to a turn, with turn_no (from 1) and turn_id.

    ``order``: columns that put rows of one time in order; without them starts come first and completions last.
    """
    by = ["timestamp", *order] if order else ["timestamp", rank()]
    session = Window.partitionBy("session_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("turn_no", F.sum(is_start().cast("long")).over(session)).filter("turn_no > 0")
    turn = Window.partitionBy("session_id", "turn_no").orderBy(*by)
    marked = numbered.withColumns({"done_before": F.coalesce(F.sum(is_done().cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "turn_id": F.first(F.when(is_start(), P("payload.turn_id")), True).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "at": F.row_number().over(turn)})
    return marked.filter("done_before = 0").drop("done_before")


def turns(events: DataFrame, include: list[str] | None = None, order: tuple[str, ...] = (), most: int = 12_000) -> DataFrame:
    """One row for each turn: session_id, turn_no, turn_id, start_time, end_time, status, tokens, rounds, calls, model, input, output.

    ``include`` keeps turns of these ids only. A turn without completion is an error and ends with its last row. Input is
    what the user said, all messages; output the last one of the assistant that is not blank; both masked and cut.
    """
    rows = in_turns(events, order)
    if include is not None:
        rows = rows.filter(P("turn_id").isin(include))
    message = (P("type") == "response_item") & (P("payload.type") == "message")
    said = F.coalesce(message_text(P("payload.content")), F.lit(""))
    user = F.when(message & (P("payload.role") == "user") & ~F.ltrim(said).startswith(PLUGINS), F.struct("at", said.alias("t")))
    answer = F.when(message & (P("payload.role") == "assistant") & (F.btrim(said, F.lit(" \t\r\n")) != ""), F.struct("at", said.alias("t")))
    usage = lambda c: F.coalesce(F.sum(F.when(token, P(f"payload.info.last_token_usage.{c}"))), F.lit(0))
    token = (P("type") == "event_msg") & (P("payload.type") == "token_count")
    call = (P("type") == "response_item") & P("payload.type").isin("custom_tool_call", "function_call")
    done = F.max(F.when(is_done(), P("timestamp")))
    context = F.min_by(F.when((P("type") == "turn_context") & P("payload.turn_id").eqNullSafe(P("turn_id")), P("payload.model")), F.when((P("type") == "turn_context") & P("payload.turn_id").eqNullSafe(P("turn_id")), P("at")))
    found = rows.groupBy("session_id", "turn_no", "turn_id").agg(
        F.min(F.when(is_start(), P("timestamp"))).alias("start_time"), F.coalesce(done, F.max_by("timestamp", "at")).alias("end_time"), F.when(done.isNull(), "error").otherwise("success").alias("status"),
        usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cached_input_tokens").alias("cached_tokens"), F.count_if(token).alias("rounds"), F.count_if(call).alias("calls"), F.count("*").alias("events"),
        context.alias("model"), F.array_join(F.transform(F.array_sort(F.collect_list(user)), lambda x: x["t"]), "\n\n").alias("said"), F.max(answer)["t"].alias("answered"))
    return found.withColumns({"model": F.coalesce("model", F.lit("unknown-model")), "input": shown(P("said"), most), "output": shown(F.coalesce("answered", F.lit("")), most)}).drop("said", "answered")


def tables(events: DataFrame, include: list[str] | None = None, order: tuple[str, ...] = (), most: int = 12_000) -> dict[str, DataFrame]:
    """traces, observations (turns, model rounds, tool calls), answers, tasks, models and sessions of rollouts."""
    t = turns(events, include, order, most).withColumn("trace_id", short_id(F.lit("trace"), P("session_id"), P("turn_no").cast("string"), F.coalesce("turn_id", F.lit(""))))
    task, model = short_id(F.lit("task"), P("input")), short_id(F.lit("model"), P("model"))
    ms = lambda a, b: (F.unix_micros(F.to_timestamp(b)) - F.unix_micros(F.to_timestamp(a))) / F.lit(1000.0)
    traces = t.select("trace_id", "session_id", task.alias("task_id"), model.alias("model_id"), "model", "turn_id", F.lit(1).alias("attempt_number"), "status", "start_time", "end_time", ms("start_time", "end_time").alias("duration_ms"), "input_tokens", "output_tokens", "cached_tokens", P("calls").alias("tool_count"), P("rounds").alias("llm_rounds"), "input", "output", F.when(P("status") == "error", "incomplete_turn").alias("error_type"))
    root = traces.select(short_id(F.lit("root"), P("trace_id")).alias("observation_id"), "trace_id", F.lit(None).cast("string").alias("parent_id"), F.lit("span").alias("type"), F.lit("turn").alias("name"), "status", "start_time", "end_time", "input", "output")
    rows = in_turns(events, order).join(t.select("session_id", "turn_no", "trace_id", "start_time"), ["session_id", "turn_no"])
    parent = short_id(F.lit("root"), P("trace_id"))
    by = Window.partitionBy("trace_id").orderBy("at")
    token = rows.filter("type = 'event_msg' and payload.type = 'token_count'").withColumns({"step": F.row_number().over(by), "began": F.coalesce(F.lag("timestamp").over(by), "start_time")})
    began = F.least("began", "timestamp")
    rounds = token.select(short_id(F.lit("round"), P("trace_id"), P("step").cast("string")).alias("observation_id"), "trace_id", parent.alias("parent_id"), F.lit("generation").alias("type"), F.concat(F.lit("step-"), "step").alias("name"), F.lit("success").alias("status"),
        F.when(began == P("timestamp"), began - F.expr("interval 1 millisecond")).otherwise(began).alias("start_time"), P("timestamp").alias("end_time"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"))
    items = rows.filter("type = 'response_item'")
    calls = items.filter(P("payload.type").isin("custom_tool_call", "function_call")).withColumn("tool_index", F.row_number().over(by)).withColumn("call_id", F.coalesce("payload.call_id", "payload.id", P("tool_index").cast("string")))
    outs = items.filter(P("payload.type").isin("custom_tool_call_output", "function_call_output")).groupBy("trace_id", P("payload.call_id").alias("call_id")).agg(F.max_by(F.struct(P("timestamp").alias("t"), P("payload.output").alias("o")), "at").alias("last"))
    text = F.coalesce("last.o", F.lit(""))
    tools = calls.join(outs, ["trace_id", "call_id"], "left").select(short_id(F.lit("tool"), P("trace_id"), P("call_id")).alias("observation_id"), "trace_id", parent.alias("parent_id"), F.lit("tool").alias("type"), F.coalesce("payload.name", F.lit("unknown-tool")).alias("name"), F.when(matches_any(text, FAILURE), "error").otherwise("success").alias("status"),
        P("timestamp").alias("start_time"), F.coalesce("last.t", P("timestamp") + F.expr("interval 1 millisecond")).alias("end_time"), shown(F.coalesce("payload.input", "payload.arguments", F.lit("")), most).alias("input"), shown(text, most).alias("output"))
    return {
        "traces": traces,
        "observations": root.unionByName(rounds).unionByName(tools),
        "answers": traces.select(short_id(F.lit("answer"), P("trace_id")).alias("answer_id"), "task_id", "trace_id", "model_id", P("output").alias("answer_text"), F.lit(None).cast("boolean").alias("correct")),
        "tasks": traces.groupBy("task_id").agg(F.min("input").alias("prompt_text")).withColumn("task_family", F.lit("user-turn")),
        "models": traces.groupBy("model_id").agg(F.min("model").alias("name")),
        "sessions": traces.groupBy("session_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("trace_count")),
    }
