import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import windows as W
from sparkwright.sources import logs, rollouts
from sparkwright.streaming import stateful as S

START = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, df, name):
    """What ``df``, a stream of files taken one at a time, gives in the end."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert not q.isActive and q.exception() is None
    rows = spark.table(name).collect()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    return rows, state


def in_files(path, chunks):
    """A file for each chunk of rows, in this order of time."""
    path.mkdir()
    for i, rows in enumerate(chunks):
        f = path / f"f{i}.json"
        f.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def rollout(seed=1):
    rng, rows, t = random.Random(seed), [], 0

    def row(session, kind, **payload):
        nonlocal t
        t += rng.randrange(1, 50)
        rows.append({"session_id": session, "timestamp": (START + dt.timedelta(seconds=t)).isoformat() + "Z", "type": kind, "payload": payload})

    for k in range(30):
        for s in ("a", "b"):
            if rng.random() < 0.2:
                row(s, "event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 1000}})  # between turns
            row(s, "event_msg", type="task_started", turn_id=f"{s}{k}")
            for _ in range(rng.randrange(3)):
                row(s, "event_msg", type="token_count", info={"last_token_usage": {"input_tokens": rng.randrange(9), "output_tokens": 2}})
            if rng.random() < 0.7:
                row(s, "event_msg", type="task_complete", turn_id=f"{s}{k}")
    row("c", "event_msg", type="task_started", turn_id="left open")
    return rows


def test_turns_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = rollout()
    later = [{"session_id": "z", "timestamp": "2024-01-09T00:00:00Z", "type": "session_meta", "payload": {"id": "z"}}, {"session_id": "z", "timestamp": "2024-01-09T00:00:01Z", "type": "other", "payload": {}}]
    n = len(rows)
    path = in_files(tmp_path / "in", [rows[: n // 3], rows[n // 3 : n // 2], rows[n // 2 :], later[:1], later[1:]])
    schema = f"session_id string, {logs.ROLLOUT}"
    got, state = streamed(spark, tmp_path, S.turn_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)), "turns")
    want = rollouts.turns(spark.read.schema(schema).json(path)).collect()
    columns = ["session_id", "turn_id", "start_time", "end_time", "status", "input_tokens", "output_tokens", "cached_tokens", "events"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r[c] for c in columns) for r in want)
    assert len(want) == 61 and {r["status"] for r in want} == {"success", "error"}


def test_rolling_sums_and_the_end_of_state(spark, tmp_path):
    rng = random.Random(2)
    hours = sorted(rng.sample(range(400), 150))
    rows = [{"key": k, "hour": (START + dt.timedelta(hours=h)).isoformat() + "Z", "n": rng.randrange(50)} for h in hours for k in ("x", "y") if rng.random() < 0.9]
    later = [{"key": "z", "hour": "2024-03-01T00:00:00Z", "n": 1}, {"key": "z", "hour": "2024-03-01T05:00:00Z", "n": 1}]
    path = in_files(tmp_path / "in", [rows[:40], rows[40:41], rows[41:], later[:1], later[1:]])
    schema = "key string, hour timestamp, n long"
    got, _ = streamed(spark, tmp_path, S.rolling_sums(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)), "rolling")
    batch = spark.read.schema(schema).json(path).withColumn("s", F.col("hour").cast("long"))
    w = lambda h: F.sum("n").over(W.Window.partitionBy("key").orderBy("s").rangeBetween(-h * 3600 + 1, 0)).alias(f"sum_{h}")
    want = batch.select("key", "hour", "n", *[w(h) for h in S.HOURS]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(rows) + 2


def test_peak_ages_over_batches(spark, tmp_path):
    peaks = [1, 1, 0, 1, 1, 1, None, 1, 1, 0, 1]  # the seventh hour lacks
    rows = [{"key": "k", "hour": (START + dt.timedelta(hours=h)).isoformat() + "Z", "is_peak": bool(p)} for h, p in enumerate(peaks) if p is not None]
    path = in_files(tmp_path / "in", [rows[:2], rows[2:5], rows[5:9], rows[9:]])
    got, _ = streamed(spark, tmp_path, S.peak_ages(spark.readStream.schema("key string, hour timestamp, is_peak boolean").option("maxFilesPerTrigger", 1).json(path)), "ages")
    assert [r["age"] for r in sorted(got, key=lambda r: r["hour"])] == [1, 2, 0, 1, 2, 3, 1, 2, 0, 1]


def line(second, kind, **payload):
    return {"timestamp": f"2024-01-01T00:00:{second:02d}Z", "type": kind, "payload": payload}


def message(second, role, *texts):
    return line(second, "response_item", type="message", role=role, content=[{"type": "text", "text": t} for t in texts])


def test_tables_of_rollouts(spark, tmp_path):
    rows = [line(0, "session_meta", id="S", thread_source="user", source="cli"), message(1, "user", "before any turn"), line(2, "event_msg", type="task_started", turn_id="t1"), line(2, "turn_context", turn_id="t1", model="m-1"),
            message(3, "user", "  <recommended_plugins> none of mine"), message(4, "user", "do", "this"), message(5, "user", "and that, password=hunter22"), line(6, "event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 5, "output_tokens": 7, "cached_input_tokens": 1}}),
            line(7, "response_item", type="function_call", call_id="c1", name="ls", arguments="{}"), line(8, "response_item", type="function_call_output", call_id="c1", output="Exit code: 1"), line(8, "response_item", type="custom_tool_call", name="cat", id="c2", input="x"),
            message(9, "assistant", "first"), message(10, "assistant", "the answer"), message(11, "assistant", "  "), line(12, "event_msg", type="task_complete", turn_id="t1"), message(13, "assistant", "after the turn"),
            line(14, "event_msg", type="task_started", turn_id="t2"), line(15, "event_msg", type="token_count", info=None), line(20, "event_msg", type="task_started", turn_id="t3"), line(20, "event_msg", type="task_complete", turn_id="t3")]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    e = rollouts.rollout_events(spark, str(tmp_path / "r.jsonl"))
    t = {r["turn_id"]: r for r in rollouts.turns(e).collect()}
    assert [(k, t[k]["status"], (t[k]["end_time"] - t[k]["start_time"]).total_seconds(), t[k]["session_id"]) for k in sorted(t)] == [("t1", "success", 10.0, "S"), ("t2", "error", 1.0, "S"), ("t3", "success", 0.0, "S")]
    one = t["t1"]
    assert one["input"] == "do\nthis\n\nand that, password=[REDACTED]" and one["output"] == "the answer"
    assert (one["model"], one["input_tokens"], one["output_tokens"], one["cached_tokens"], one["rounds"], one["calls"]) == ("m-1", 5, 7, 1, 1, 2)
    assert (t["t2"]["input"], t["t2"]["output"], t["t2"]["model"], t["t2"]["input_tokens"], t["t2"]["rounds"]) == ("", "", "unknown-model", 0, 1)
    assert [r["turn_id"] for r in rollouts.turns(e, include=["t3", "t9"]).collect()] == ["t3"]
    b = rollouts.tables(e)
    o = {(r["type"], r["name"]): r for r in b["observations"].filter(F.col("trace_id").isin([r["trace_id"] for r in b["traces"].filter("turn_id = 't1'").collect()])).collect()}
    assert set(o) == {("span", "turn"), ("generation", "step-1"), ("tool", "ls"), ("tool", "cat")}
    assert o["tool", "ls"]["status"] == "error" and (o["tool", "cat"]["end_time"] - o["tool", "cat"]["start_time"]).total_seconds() == 0.001 and o["tool", "ls"]["parent_id"] == o["span", "turn"]["observation_id"]
    assert sorted((r["answer_text"], r["correct"]) for r in b["answers"].collect()) == [("", None), ("", None), ("the answer", None)]
    assert [(r["session_id"], r["trace_count"]) for r in b["sessions"].collect()] == [("S", 3)] and b["models"].count() == 2 and b["tasks"].count() == 2
    (tmp_path / "sub.jsonl").write_text(json.dumps(line(0, "session_meta", id="x", source={"subagent": 1})))
    with pytest.raises(ValueError, match="subagent"):
        rollouts.rollout_events(spark, str(tmp_path / "sub.jsonl"))
