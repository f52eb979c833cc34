"""Deep chains, cycles, and the studies' operators that the test tables don't reach."""

import json

from pyspark.sql import functions as F

from sparkwright.plans import studies, traces
from sparkwright.sources.trips import cell_distance, ring
from sparkwright.streaming import events as streaming
from sparkwright.streaming import stateful


def walked(parents):
    """{id: depth} by following each walk."""
    out = {}
    for i in parents:
        depth, seen, at = 1, set(), i
        while at in parents and parents[at] is not None and parents[at] not in seen:
            seen.add(parents[at])
            depth, at = depth + 1, parents[at]
        out[i] = depth
    return out


def test_depths_of_long_chains_and_cycles(spark):
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(200)}
    parents |= {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {"s": "s", "t0": "r3", "t1": "t0", "t2": "t1", "lost": "nowhere", "u": "lost"}
    df = spark.createDataFrame([(i, "t", p) for i, p in parents.items()], "observation_id string, trace_id string, parent_id string")
    assert {r["observation_id"]: r["depth"] for r in traces.depths(df).collect()} == walked(parents)
    assert traces.depths(df.limit(0)).count() == 0


def test_revision_cycles_of_any_length(spark):
    prior = {f"r{i}": f"r{(i + 1) % 50}" for i in range(50)} | {"a": "b", "b": "c", "c": None, "t": "r4", "u": "t", "s": "s", "x": "gone"}
    df = spark.createDataFrame(list(prior.items()), "annotation_id string, supersedes string")
    got = traces.revision_cycles(df).collect()
    assert sorted(r["annotation_id"] for r in got) == sorted([*[f"r{i}" for i in range(50)], "s"])
    assert traces.revision_cycles(df.filter("annotation_id in ('a', 'b', 'c', 'x')")).count() == 0


def test_replies(spark):
    reply = lambda *p: json.dumps({"predictions": [{"case_id": c, "label": x, "evidence": e} for c, x, e in p]})
    texts = [reply(("1", "end", ["S0"]), ("2", "end", ["S9"])), f"```json\n{reply(('1', 'maybe', []))}\n```", "none", None, "[1]", reply(("7", "end", []))]
    allowed = spark.createDataFrame([("1", ["S0"]), ("2", ["S0"])], "case_id string, eligible array<string>")
    got = studies.replies(spark.createDataFrame([(t,) for t in texts], "content string"), "content", ("continue", "end"), allowed).collect()
    assert sorted((r["case_id"] or "", r["problem"] or "") for r in got) == [("", "malformed"), ("", "malformed"), ("", "malformed"), ("1", ""), ("1", "invalid_label"), ("2", "evidence_not_allowed"), ("7", "unknown_case")]


def test_grid(spark):
    r = spark.range(1).select(F.sort_array(ring(F.lit("0:0"))).alias("a"), F.size(ring(F.lit("5:-3"), 2)).alias("b"), cell_distance(F.lit("5:-3"), F.lit("2:-4")).alias("c")).first()
    assert r["a"] == sorted(f"{i}:{j}" for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)) and (r["b"], r["c"]) == (24, 3)


def test_lateness_and_peak_ages(spark, tmp_path):
    rows = [("k", f"2024-01-01 {h:02d}:00:00", f"2024-01-01 {h:02d}:00:{s:02d}", p) for h, s, p in ((0, 1, True), (1, 5, True), (2, 0, False), (3, 9, True), (5, 3, True), (6, 2, True), (12, 0, False))]
    table = spark.createDataFrame(rows, "key string, ts string, seen string, is_peak boolean").select("key", F.to_timestamp("ts").alias("ts"), F.to_timestamp("seen").alias("seen"), "is_peak")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, df in (("late", streaming.lateness(source(), "key", "seen")), ("age", stateful.peak_ages(source().select("key", F.col("ts").alias("hour"), "is_peak")))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r["hour"].hour: r["max_s"] for r in spark.table("late").collect()} == {0: 1.0, 1: 5.0, 2: 0.0, 3: 9.0, 5: 3.0, 6: 2.0}
    assert [r["age"] for r in spark.table("age").orderBy("hour").collect()] == [1, 2, 0, 1, 1, 2, 0]


def test_a_resample_draws_as_many_as_there_are(spark):
    import hashlib
    from collections import Counter

    from sparkwright.operators.tables import written
    from sparkwright.plans.traces import drawn_by

    names = [f"n{i}" for i in range(300)] + ["a"] * 500 + [None] * 40
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    counts = written(rows.groupBy("name").agg(F.count("*").alias("c")), "counts")
    line = sorted((n for n in names if n), key=str) + [None] * 40
    want = Counter()
    for rep in range(7):
        for i in range(len(names)):
            u = int(hashlib.md5(f"5:{rep}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            want[rep, line[int(u * len(names))]] += 1
    got = {(r["rep"], r["name"]): r["c"] for r in drawn_by(counts, "name", "c", rows, F.col("id"), 7, 5).collect()}
    assert got == dict(want)


def test_permutations_compare_hashes_as_text(spark):
    """Each draw turned into a number took longer than the hash; tasks whose sum no order changes are not drawn at all."""
    from sparkwright.plans.bundle import stand_in

    out = traces.q21(stand_in(spark, "/root/testdata/sf0.001"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and "conv(" not in plan and "moves" in plan
