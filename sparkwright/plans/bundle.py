"""The canonical tables of agent traces, and how the test tables stand in for them.

Canonical columns (times as microseconds, nested values flattened):
models(model_id) · tasks(task_id, task_family, difficulty) · sessions(session_id)
traces(trace_id, session_id, task_id, model_id, attempt_number, status, start_us, end_us, duration_ms, input_tokens,
output_tokens, cache_tokens, cost, turn, tool_count, llm_rounds, error_type, output)
observations(observation_id, trace_id, parent_id, type, name, status, start_us, end_us, tool_index, output)
answers(answer_id, task_id, trace_id, model_id, correct)
annotations(annotation_id, target_type, target_id, trace_id, schema_version, label, confidence, annotator_id,
annotator_type, labeled_us, ingested_us, source, supersedes, retracted)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.scalars import micros


@dataclass(frozen=True)
class Config:
    selected_models: tuple[str, ...] = ("m0", "m1")
    seed: int = 42
    bootstrap_repetitions: int = 300
    permutation_repetitions: int = 300
    minimum_window: int = 30


class Bundle:
    """The tables by name, each made when it is first asked for."""

    def __init__(self, config: Config = Config(), **tables: Callable[[], DataFrame]):
        self.config, self.tables = config, tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.__dict__.get("tables", {}):
            table = self.tables[name]()
            setattr(self, name, table)
            return table
        raise AttributeError(name)


def text_id(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


class StandIn:
    """The tables made from ``events`` and ``labels`` by arithmetic on their ids, so that SQL can make the same."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    def traces(self) -> DataFrame:
        e, start = F.col("event_id"), micros(F.col("ts"))
        duration = F.round(F.col("value") * 1000).cast("long")
        status = F.when(F.col("event_type") == "error", "error").when((F.col("event_type") == "signup") & (e % 5 == 0), "cancelled").otherwise("success")
        return self.events.select(
            text_id("e", e).alias("trace_id"), text_id("s", F.col("user_id")).alias("session_id"), text_id("t", F.floor(e / 12)).alias("task_id"), F.when(e % 331 == 0, F.lit(None)).otherwise(text_id("m", e % 3)).alias("model_id"),
            (F.floor(e / 291) % 4 + 1).cast("long").alias("attempt_number"), status.alias("status"), start.alias("start_us"), (start + duration * F.when(e % 401 == 0, -1000).otherwise(1000)).alias("end_us"), duration.alias("duration_ms"),
            F.when(e % 50 != 0, e * 7 % 1009).alias("input_tokens"), F.when(e % 53 != 0, e * 11 % 503).alias("output_tokens"), (e % 17 * 10).alias("cache_tokens"), F.when(e % 59 != 0, F.round(F.col("value") / 1000, 6)).alias("cost"),
            F.get_json_object("props", "$.k").cast("long").alias("turn"), (e % 6).alias("tool_count"), (e % 4 + 1).alias("llm_rounds"), F.when(F.col("event_type") == "error", text_id("kind", e % 4)).alias("error_type"),
            F.when(e % 13 == 0, F.lit(None)).when(e % 17 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("Ran Notebook_V"), (e % 5).cast("string"), F.lit(" then notebook_v"), (e % 7).cast("string"), F.lit(" ✓"))).alias("output"))

    def observations(self) -> DataFrame:
        e, i, start = F.col("event_id"), F.col("i"), micros(F.col("ts"))
        duration = (e * 37 + i * 101) % 5000 + i
        each = self.events.select("event_id", start.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), e % 5)).alias("i"))
        return each.select(
            F.concat(text_id("e", e), F.lit("."), i.cast("string")).alias("observation_id"), F.when((e % 211 == 0) & (i == 1), "missing").otherwise(text_id("e", e)).alias("trace_id"),
            F.when(i == 0, F.lit(None)).when((e % 157 == 0) & (i == 2), "gone").otherwise(F.concat(text_id("e", e), F.lit("."), F.floor((i - 1) / 2).cast("string"))).alias("parent_id"),
            F.when(i == 0, "span").when(i % 3 == 1, "tool").when(i % 3 == 2, "generation").otherwise("event").alias("type"), F.when(i % 3 == 1, text_id("tool:x", (e * 7 + i) % 9)).otherwise(F.lit("step")).alias("name"),
            F.when((e * 13 + i * 5) % 11 == 0, "error").when((e * 13 + i * 5) % 11 == 1, "cancelled").otherwise("success").alias("status"), (F.col("s") + i * 1_000_000).alias("start_us"), (F.col("s") + i * 1_000_000 + duration * 1000).alias("end_us"), i.alias("tool_index"),
            F.when((e % 29 == 0) & (i == 1), F.lit("see notebook_v99")).alias("output"))

    def answers(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(text_id("a", e).alias("answer_id"), F.when(e % 613 == 0, "t-1").otherwise(text_id("t", F.floor(e / 12))).alias("task_id"), F.when(e % 499 == 0, "gone").otherwise(text_id("e", e)).alias("trace_id"), text_id("m", e % 3).alias("model_id"), F.when((e % 41 != 0) & (e % 4 != 3), e * 31 % 7 < 3 + e % 3).alias("correct"))

    def annotations(self) -> DataFrame:
        labels = self.spark.read.parquet(f"{self.sf_dir}/labels.parquet").filter("doc_id is not null")
        d, k = F.col("doc_id"), F.col("k")
        label = F.when(k == 0, F.col("quality") == 1).when(k == 1, F.col("toxic") == 0).otherwise((F.col("quality") == 1) != (d % 9 == 0))
        notes = labels.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(d % 8 == 0, 3).otherwise(2))))
        return notes.select(
            F.concat(text_id("n", d), F.lit("."), k.cast("string")).alias("annotation_id"), F.lit("trace").alias("target_type"), F.when(d % 71 == 0, "nowhere").otherwise(text_id("e", d)).alias("target_id"), F.when(d % 67 == 0, "e1").otherwise(text_id("e", d)).alias("trace_id"), F.lit("v1").alias("schema_version"),
            F.when(d % 61 != 0, label).alias("label"), (d % 11 / 10).alias("confidence"), F.when((d % 59 == 0) & (k == 1), F.lit(None)).otherwise(text_id("h", F.when(k == 3, 0).otherwise(k))).alias("annotator_id"), F.when(k == 2, "llm").otherwise("human").alias("annotator_type"),
            (d * 60_000_000 + k * 1_000_000 + F.when((d % 96 == 0) & (k == 3), -9_000_000).otherwise(0)).alias("labeled_us"), (d * 60_000_000 + k * 1_000_000 + d % 40 * 1_000_000 - F.when(d % 83 == 0, 50_000_000).otherwise(0)).alias("ingested_us"), F.lit("review").alias("source"),
            F.when(k == 3, F.when(d % 88 == 0, "n-1.0").otherwise(F.concat(text_id("n", d), F.lit(".0")))).alias("supersedes"), ((k == 3) & (d % 40 == 0)).alias("retracted"))

    def tasks(self) -> DataFrame:
        i = F.floor(F.col("event_id") / 12)
        return self.events.select(i.alias("id")).distinct().select(text_id("t", F.col("id")).alias("task_id"), F.element_at(F.array(*map(F.lit, ("coding", "research", "ops"))), (F.col("id") % 3 + 1).cast("int")).alias("task_family"), F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard", "unknown"))), (F.col("id") % 4 + 1).cast("int")).alias("difficulty"))


def stand_in(spark: SparkSession, sf_dir: str) -> Bundle:
    made = StandIn(spark, sf_dir)
    models = lambda: spark.range(3).select(text_id("m", F.col("id")).alias("model_id"))
    sessions = lambda: made.events.select(text_id("s", F.col("user_id")).alias("session_id")).distinct()
    return Bundle(models=models, tasks=made.tasks, sessions=sessions, traces=made.traces, observations=made.observations, answers=made.answers, annotations=made.annotations)


#: The same tables as common table expressions of DuckDB.
STAND_IN_SQL = r"""
ev AS (SELECT *, epoch_us(ts) AS us, CAST(round(value * 1000) AS BIGINT) AS dur FROM events),
traces AS (SELECT 'e' || event_id AS trace_id, 's' || user_id AS session_id, 't' || (event_id // 12) AS task_id, CASE WHEN event_id % 331 <> 0 THEN 'm' || (event_id % 3) END AS model_id,
  (event_id // 291) % 4 + 1 AS attempt_number, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'cancelled' ELSE 'success' END AS status,
  us AS start_us, us + dur * CASE WHEN event_id % 401 = 0 THEN -1000 ELSE 1000 END AS end_us, dur AS duration_ms,
  CASE WHEN event_id % 50 <> 0 THEN event_id * 7 % 1009 END AS input_tokens, CASE WHEN event_id % 53 <> 0 THEN event_id * 11 % 503 END AS output_tokens, event_id % 17 * 10 AS cache_tokens, CASE WHEN event_id % 59 <> 0 THEN round(value / 1000, 6) END AS cost,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS turn, event_id % 6 AS tool_count, event_id % 4 + 1 AS llm_rounds, CASE WHEN event_type = 'error' THEN 'kind' || (event_id % 4) END AS error_type,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ' ' || chr(10) || ' ' ELSE 'Ran Notebook_V' || (event_id % 5) || ' then notebook_v' || (event_id % 7) || ' ✓' END AS output FROM ev),
observations AS (SELECT 'e' || event_id || '.' || i AS observation_id, CASE WHEN event_id % 211 = 0 AND i = 1 THEN 'missing' ELSE 'e' || event_id END AS trace_id,
  CASE WHEN i = 0 THEN NULL WHEN event_id % 157 = 0 AND i = 2 THEN 'gone' ELSE 'e' || event_id || '.' || ((i - 1) // 2) END AS parent_id,
  CASE WHEN i = 0 THEN 'span' WHEN i % 3 = 1 THEN 'tool' WHEN i % 3 = 2 THEN 'generation' ELSE 'event' END AS type, CASE WHEN i % 3 = 1 THEN 'tool:x' || ((event_id * 7 + i) % 9) ELSE 'step' END AS name,
  CASE (event_id * 13 + i * 5) % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'cancelled' ELSE 'success' END AS status, us + i * 1000000 AS start_us, us + i * 1000000 + ((event_id * 37 + i * 101) % 5000 + i) * 1000 AS end_us, i AS tool_index,
  CASE WHEN event_id % 29 = 0 AND i = 1 THEN 'see notebook_v99' END AS output FROM ev, range(0, 5) r(i) WHERE i <= event_id % 5),
answers AS (SELECT 'a' || event_id AS answer_id, 't' || CASE WHEN event_id % 613 = 0 THEN -1 ELSE event_id // 12 END AS task_id, CASE WHEN event_id % 499 = 0 THEN 'gone' ELSE 'e' || event_id END AS trace_id, 'm' || (event_id % 3) AS model_id,
  CASE WHEN event_id % 41 <> 0 AND event_id % 4 <> 3 THEN event_id * 31 % 7 < 3 + event_id % 3 END AS correct FROM ev),
tasks AS (SELECT 't' || id AS task_id, ['coding', 'research', 'ops'][id % 3 + 1] AS task_family, ['easy', 'medium', 'hard', 'unknown'][id % 4 + 1] AS difficulty FROM (SELECT DISTINCT event_id // 12 AS id FROM events)),
notes AS (SELECT *, CASE k WHEN 0 THEN quality = 1 WHEN 1 THEN toxic = 0 ELSE (quality = 1) <> (doc_id % 9 = 0) END AS lab FROM labels, range(0, 4) r(k) WHERE k <= CASE WHEN doc_id % 8 = 0 THEN 3 ELSE 2 END),
annotations AS (SELECT 'n' || doc_id || '.' || k AS annotation_id, 'trace' AS target_type, CASE WHEN doc_id % 71 = 0 THEN 'nowhere' ELSE 'e' || doc_id END AS target_id, CASE WHEN doc_id % 67 = 0 THEN 'e1' ELSE 'e' || doc_id END AS trace_id, 'v1' AS schema_version,
  CASE WHEN doc_id % 61 <> 0 THEN lab END AS label, CASE WHEN doc_id % 59 = 0 AND k = 1 THEN NULL ELSE 'h' || CASE WHEN k = 3 THEN 0 ELSE k END END AS annotator_id, CASE WHEN k = 2 THEN 'llm' ELSE 'human' END AS annotator_type,
  doc_id * 60000000 + k * 1000000 + CASE WHEN doc_id % 96 = 0 AND k = 3 THEN -9000000 ELSE 0 END AS labeled_us, doc_id * 60000000 + k * 1000000 + doc_id % 40 * 1000000 - CASE WHEN doc_id % 83 = 0 THEN 50000000 ELSE 0 END AS ingested_us, 'review' AS source,
  CASE WHEN k = 3 THEN CASE WHEN doc_id % 88 = 0 THEN 'n-1.0' ELSE 'n' || doc_id || '.0' END END AS supersedes, k = 3 AND doc_id % 40 = 0 AS retracted FROM notes)"""
