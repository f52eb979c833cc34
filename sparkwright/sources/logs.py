"""Session logs and rollouts (JSON lines) to canonical traces and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions.text import matches_any, redacted, short_id, truncated

EVENT = "ts timestamp, session_id string, turn int, type string, model string, user_input string, assistant_output string, duration_ms double, tokens_in long, tokens_out long, tool_count int, error string, agentic_step int, tool_calls array<struct<tool_call_id:string, name:string, ok:boolean, ms:double, start_offset_ms:double, args_preview:string, result_preview:string>>"
ROLLOUT = "timestamp timestamp, type string, payload struct<type:string, turn_id:string, id:string, thread_source:string, source:string, role:string, call_id:string, name:string, input:string, arguments:string, output:string, content:array<struct<type:string, text:string>>, model:string, info:struct<last_token_usage:struct<input_tokens:long, output_tokens:long, cached_input_tokens:long>>>"
FAILURE = ["traceback (most recent call last)", "exit code: 1", "error:"]


def shown(c: Column, most: int) -> Column:
    return truncated(redacted(c), most)


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of session files; the file's name is the session where an event names none."""
    rows = spark.read.schema(EVENT).json(path)
    return rows.withColumn("session_id", F.coalesce("session_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1)))


def session_traces(events: DataFrame, most: int = 12_000) -> DataFrame:
    """One trace for each finished or failed turn; a turn's rounds are those of its time."""
    t = events.filter(F.col("type").isin("turn", "turn_error"))
    start = F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(F.col("duration_ms"), F.lit(0.0)) / 1000)
    w = Window.partitionBy("session_id").orderBy("ts", "turn")
    return t.select(short_id(F.col("session_id"), F.col("turn").cast("string"), F.col("ts").cast("string")).alias("trace_id"), "session_id", F.col("turn"), F.row_number().over(w).alias("attempt_number"), F.when((F.col("type") == "turn_error") | F.col("error").isNotNull(), "error").otherwise("success").alias("status"), start.alias("start_time"), F.col("ts").alias("end_time"), "duration_ms", F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"), "tool_count", "model", shown(F.col("user_input"), most).alias("input"), shown(F.col("assistant_output"), most).alias("output"), F.col("error").alias("error_type"))


def session_observations(events: DataFrame, traces: DataFrame, most: int = 12_000) -> DataFrame:
    """Rounds and their tool calls, each in the trace whose turn and time hold it (to a second after its end)."""
    r = events.filter("type = 'llm_round'").select("session_id", "turn", "ts", "agentic_step", "duration_ms", "tool_calls")
    t = traces.select("trace_id", "session_id", "turn", "start_time", "end_time")
    own = r.join(t, ["session_id", "turn"]).filter((F.col("ts") >= F.col("start_time")) & (F.col("ts") <= F.col("end_time") + F.expr("interval 1 second")))
    root = t.select(F.concat_ws(":", "trace_id", F.lit("root")).alias("observation_id"), "trace_id", F.lit(None).cast("string").alias("parent_id"), F.lit("span").alias("type"), F.lit("turn").alias("name"), F.lit("success").alias("status"), F.lit(0).alias("tool_index"), F.lit(None).cast("string").alias("output"))
    rounds = own.select(F.concat_ws(":", "trace_id", "agentic_step").alias("observation_id"), "trace_id", F.concat_ws(":", "trace_id", F.lit("root")).alias("parent_id"), F.lit("generation").alias("type"), F.lit("llm_round").alias("name"), F.lit("success").alias("status"), F.lit(0).alias("tool_index"), F.lit(None).cast("string").alias("output"))
    calls = own.select("trace_id", "agentic_step", F.posexplode("tool_calls").alias("k", "c")).select(F.concat_ws(":", "trace_id", "agentic_step", "k").alias("observation_id"), "trace_id", F.concat_ws(":", "trace_id", "agentic_step").alias("parent_id"), F.lit("tool").alias("type"), F.col("c.name").alias("name"), F.when(F.col("c.ok"), "success").otherwise("error").alias("status"), (F.col("k") + 1).alias("tool_index"), shown(F.col("c.result_preview"), most).alias("output"))
    return root.unionByName(rounds).unionByName(calls)


def rollout_calls(rollout: DataFrame, most: int = 12_000) -> DataFrame:
    """Tool calls with their last output by call id; one without an output ends a millisecond after it began."""
    p = F.col("payload")
    items = rollout.filter("type = 'response_item'")
    calls = items.filter(p["type"].isin("custom_tool_call", "function_call")).select(p["call_id"].alias("call_id"), p["name"].alias("name"), F.col("timestamp").alias("start_time"), shown(F.coalesce(p["input"], p["arguments"]), most).alias("input"))
    outs = items.filter(p["type"].endswith("_output")).groupBy(p["call_id"].alias("call_id")).agg(F.max_by(F.struct(F.col("timestamp").alias("t"), p["output"].alias("o")), "timestamp").alias("last"))
    j = calls.join(outs, "call_id", "left")
    text = F.col("last.o")
    return j.select("call_id", "name", "start_time", F.coalesce(F.col("last.t"), F.col("start_time") + F.expr("interval 1 millisecond")).alias("end_time"), "input", shown(text, most).alias("output"), F.when(F.coalesce(matches_any(text, FAILURE), F.lit(False)), "error").otherwise("success").alias("status"))


def rollout_turns(rollout: DataFrame) -> DataFrame:
    """turn_id, start, end, status: turns between their markers; one without an end is an error and ends with its last event."""
    p = F.col("payload")
    w = Window.partitionBy("file").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    marked = rollout.withColumn("file", F.input_file_name()).withColumn("turn", F.last(F.when(p["type"] == "task_started", p["turn_id"]), True).over(w)).filter("turn is not null")
    done = F.max(F.when(p["type"] == "task_complete", F.col("timestamp")))
    return marked.groupBy("file", F.col("turn").alias("turn_id")).agg(F.min("timestamp").alias("start_time"), F.coalesce(done, F.max("timestamp")).alias("end_time"), F.when(done.isNull(), "error").otherwise("success").alias("status"), F.sum(p["info"]["last_token_usage"]["input_tokens"]).alias("input_tokens"), F.sum(p["info"]["last_token_usage"]["output_tokens"]).alias("output_tokens")).drop("file")


def message_text(content: Column) -> Column:
    return F.array_join(F.transform(F.filter(content, lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n")
