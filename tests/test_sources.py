import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.operators.validation import Rules, violations
from sparkwright.sources import files, logs, trips
from sparkwright.streaming import events as streaming


def test_trips(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Trip ID,Trip Start Timestamp,Trip Seconds,Fare,Shared Trip Authorized,Pickup Centroid Location,Pickup Centroid Latitude,Pickup Centroid Longitude,Dropoff Centroid Location\n'
        'a,03/09/2024 02:05:00 PM,60,3.5,true,"POINT (1, 2)",41.88,-87.6,\nb,,x,-1,,"POINT (1, 2)",41.88,-87.6,"POINT (9, 9)"\n')
    staged = files.csv_table(spark, str(tmp_path / "t.csv"))
    t = trips.clean(staged, "2024")
    rows = {r["trip_id"]: r for r in t.collect()}
    assert str(rows["a"]["trip_start_timestamp"]) == "2024-03-09 14:05:00" and rows["a"]["shared_trip_authorized"] == 1
    assert (rows["b"]["trip_seconds"], rows["b"]["fare"], rows["b"]["shared_trip_authorized"], rows["b"]["shared_trip_match"]) == (None, -1.0, None, None)
    q = trips.quality(t).first()
    assert (q["rows"], q["fare_negative"], q["trip_start_timestamp_null"]) == (2, 1, 1)
    cells = trips.places(t, trips.grid_cell())
    assert cells.count() == 2
    got = trips.with_cells(t, cells).collect()
    assert len(got) == 2 and got[0]["pickup_cell"] == got[1]["pickup_cell"] is not None
    assert t.filter(trips.not_shared(F.col("shared_trip_authorized"))).count() == 1 and t.filter(trips.not_shared(F.col("shared_trip_authorized"), False)).count() == 0


def test_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    df = spark.createDataFrame([(1, "x"), (2, None)], schema)
    files.write_json_lines(df, str(tmp_path / "o"))
    assert files.json_lines(spark, str(tmp_path / "o"), schema).count() == 2
    assert {r["json"] for r in files.answer_json(df).collect()} == {'{"a":1,"b":"x"}', '{"a":2,"b":null}'}
    m = files.manifest({"t": df, "u": df.filter("a > 5")}).collect()
    assert [r["rows"] for r in m] == [2, 0] and files.manifest({"t": df.orderBy(F.desc("a"))}).first()["digest"] == m[0]["digest"]
    assert [(r["a"], r["side"]) for r in files.difference(df, df.filter("a = 1"), "a").collect()] == [(2, "left")]
    made = []
    make = lambda w: made.append(w.count()) or w.withColumn("v", F.col("id") * 2)
    files.resumed(spark, str(tmp_path / "r"), spark.range(3), "id", make)
    assert files.resumed(spark, str(tmp_path / "r"), spark.range(5), "id", make).count() == 5 and made == [3, 2]
    b = files.batched(spark.createDataFrame([(g, i) for g in range(4) for i in range(3)], "g int, i int"), "g", "i", 6)
    assert b.groupBy("g").agg(F.countDistinct("batch")).filter("`count(DISTINCT batch)` > 1").count() == 0 and b.groupBy("batch").count().agg(F.max("count")).first()[0] <= 6


def test_tables_of_the_catalog(spark):
    df = spark.createDataFrame([(1, "2.5")], "a int, b string")
    try:
        assert not files.table_exists(spark, "made_here")
        files.created_as(df.select("a", F.col("b").cast("double").alias("b")), "made_here")
        with pytest.raises(ValueError, match="exists"):
            files.created_as(df, "made_here")
        files.inserted(df, "made_here")
        files.inserted(df.select("b"), "made_here")
        assert sorted(map(str, spark.table("made_here").collect())) == sorted(map(str, [Row(a=1, b=2.5), Row(a=1, b=2.5), Row(a=None, b=2.5)]))
        with pytest.raises(ValueError, match="has no"):
            files.inserted(df.withColumn("c", F.lit(1)), "made_here")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            files.inserted(spark.createDataFrame([("x",)], "b string"), "made_here")
    finally:
        spark.sql("DROP TABLE IF EXISTS made_here")


def test_logs(spark, tmp_path):
    lines = [{"type": "llm_round", "ts": "2024-01-01T00:00:01Z", "turn": 1, "agentic_step": 1, "duration_ms": 10, "tool_calls": [{"name": "read", "ok": True, "result_preview": "password=hunter22 ok"}, {"name": "run", "ok": False}]},
             {"type": "turn", "ts": "2024-01-01T00:00:02Z", "turn": 1, "duration_ms": 2000, "user_input": "hi", "assistant_output": "done", "tokens_in": 5, "tokens_out": 7, "tool_count": 2},
             {"type": "turn_error", "ts": "2024-01-01T00:01:00Z", "turn": 2, "duration_ms": 100, "error": "boom"}]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    e = logs.session_events(spark, str(tmp_path / "s1.jsonl"))
    t = logs.session_traces(e)
    assert sorted((r["session_id"], r["turn"], r["status"], r["attempt_number"]) for r in t.collect()) == [("s1", 1, "success", 1), ("s1", 2, "error", 2)]
    o = {(r["type"], r["name"]): r for r in logs.session_observations(e, t).collect()}
    assert set(o) == {("span", "turn"), ("generation", "llm_round"), ("tool", "read"), ("tool", "run")}
    assert o["tool", "read"]["output"] == "password=[REDACTED] ok" and o["tool", "run"]["status"] == "error"
    item = lambda ts, **p: {"timestamp": f"2024-01-01T00:00:{ts:02d}Z", "type": "response_item", "payload": p}
    mark = lambda ts, kind, turn: {"timestamp": f"2024-01-01T00:00:{ts:02d}Z", "type": "event_msg", "payload": {"type": kind, "turn_id": turn}}
    rows = [mark(1, "task_started", "t1"), item(2, type="function_call", call_id="c1", name="ls", arguments="{}"), item(3, type="function_call_output", call_id="c1", output="Exit code: 1"), item(4, type="custom_tool_call", call_id="c2", name="cat", input="x"), mark(5, "task_complete", "t1"), mark(6, "task_started", "t2"), item(9, type="message")]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    r = spark.read.schema(logs.ROLLOUT).json(str(tmp_path / "r.jsonl"))
    assert sorted((x["call_id"], x["status"], (x["end_time"] - x["start_time"]).total_seconds()) for x in logs.rollout_calls(r).collect()) == [("c1", "error", 1.0), ("c2", "success", 0.001)]
    assert sorted((x["turn_id"], x["status"]) for x in logs.rollout_turns(r).collect()) == [("t1", "success"), ("t2", "error")]


def test_validation(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 9, 2), (2, None, None)], "id int, parent int, t int")
    got = {r["rule"]: r["n"] for r in violations({"a": a, "p": spark.createDataFrame([(1,)], "id int")}, Rules({"a": "id", "p": "id"}, {"a": ("parent",)}, (("a", "parent", "p", "id"),), (("a", "t above 3", F.col("t") > 3),))).collect()}
    assert got == {"a.id:repeated": 2, "a.parent:missing": 1, "a.parent:orphan": 1, "a:t above 3": 1}


def test_streaming(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "k", h) for h in range(12) for m in (5, 25)]
    spark.createDataFrame(rows, "ts string, key string, v int").select(F.to_timestamp("ts").alias("ts"), "key", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("ts timestamp, key string, v int").parquet(str(tmp_path / "in"))
    for name, df, n in (("h", streaming.hourly(source(), "key"), 2), ("s", streaming.sliding(source(), "key", 3), 2), ("v", streaming.visits(source(), "key"), None)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name).collect()
        if n:
            assert got and all(r["n"] in (2, 4, 6) for r in got)


def test_upserts_cost_what_the_batch_holds_and_survive_restarts(spark, tmp_path):
    table, changes = str(tmp_path / "t"), tmp_path / "in"
    for i, rows in enumerate([[("a", 1, "x"), ("b", 1, "x")], [("a", 3, "z"), ("a", 2, "y")], [("c", 1, "x"), ("b", 0, "old")]]):
        spark.createDataFrame(rows, "key string, v int, value string").coalesce(1).write.mode("append").parquet(str(changes))
        q = streaming.upserts(spark.readStream.schema("key string, v int, value string").parquet(str(changes)), table, "key", "v", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(100)
        assert q.exception() is None
        assert spark.read.parquet(f"{table}/batch={i}").count() == len({r[0] for r in rows})
        if i == 1:
            streaming.compacted(spark, table, "key", "v")  # one delta beside the last: nothing to do
    want = [("a", 3, "z"), ("b", 1, "x"), ("c", 1, "x")]
    read = lambda: sorted(map(tuple, streaming.current(spark, table, "key", "v").collect()))
    assert read() == want
    streaming.compacted(spark, table, "key", "v")
    assert read() == want and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["batch=-1", "batch=2"]
