import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkwright.plans import event_study as E
from sparkwright.sources import variants as V

DAY = dt.datetime(2024, 1, 1)


def test_outside_of_intervals_against_each(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(500)) for i in range(400)] + [(900, None)]
    intervals = [(s, s + rng.randrange(-3, 12)) for s in (rng.randrange(500) for _ in range(30))] + [(None, 5), (5, None), (40, 90), (45, 60)]
    got = E.outside(spark.createDataFrame(points, "id int, `t.x` int").withColumnRenamed("t.x", "t"), "t", spark.createDataFrame(intervals, "a int, b int"), "a", "b")
    real = [(a, b) for a, b in intervals if a is not None and b is not None and a <= b]
    assert sorted(r["id"] for r in got.collect()) == [i for i, t in points if t is not None and not any(a <= t <= b for a, b in real)]
    assert E.outside(got, "t", spark.createDataFrame([], "a int, b int"), "a", "b").count() == got.count()


def test_placebos_keep_clear_of_events_and_of_the_ends(spark):
    at = lambda d, h=0: DAY + dt.timedelta(days=d, hours=h)
    events = spark.createDataFrame([(at(20, 19),), (at(27, 19),)], "anchor timestamp_ntz")
    span = spark.createDataFrame([(at(6), at(45))], "first timestamp_ntz, last timestamp_ntz")
    closed = spark.createDataFrame([(at(20, 11), at(21, 5)), (at(34, 21), at(34, 21))], "start timestamp_ntz, end timestamp_ntz")
    got = {(r["matched"], r["anchor"]) for r in E.placebo_anchors(events, span, range(-4, 6), closed, days=21).collect()}
    # 14 days before the first is day 6, its window is whole; day 34 is closed for one hour; day 48 is not known
    assert got == {(at(20, 19), at(6, 19)), (at(20, 19), at(13, 19)), (at(20, 19), at(41, 19)), (at(27, 19), at(6, 19)), (at(27, 19), at(13, 19)), (at(27, 19), at(41, 19))}


def test_signatures_and_comparison(spark):
    hours = lambda a: [(k, a + dt.timedelta(hours=o), float(o) if k == "in" else -float(o)) for k in ("in", "out") for o in range(-2, 3)]
    a, b, c = DAY, DAY + dt.timedelta(days=7), DAY + dt.timedelta(days=14)
    z = spark.createDataFrame([*hours(a), *[(k, h, v - 1) for k, h, v in hours(b)], *hours(c)[:-1]], "key string, hour timestamp_ntz, robust_z double")
    windows = spark.createDataFrame([(a, a, "event"), (a, b, "placebo"), (a, c, "placebo")], "matched timestamp_ntz, anchor timestamp_ntz, sample string")
    s = E.signatures(z, windows, range(-2, 3), ("in", (-2, -1)), ("out", (1, 2)))
    got = {r["anchor"]: r for r in s.collect()}
    assert set(got) == {a, b}  # the third lacks an hour
    assert (got[a]["arrival_score"], got[a]["arrival_peak"], got[a]["arrival_hour"], got[a]["exit_score"], got[a]["exit_hour"]) == (-1.5, -1.0, -1, -1.5, 1)
    one = E.compared(s).first()
    assert (one["placebos"], one["arrival_p95"], one["arrival_above"], one["arrival_share"], one["arrival_rank"]) == (1, -2.5, True, 1.0, 1)


def test_bad_lines_are_named_by_number(spark, tmp_path):
    lines = ['{"a":1}', "", '{"a":"x"}', "  ", '{"b":[1]}']
    (tmp_path / "good.jsonl").write_text("\n".join(lines * 50))
    assert V.objects(spark, str(tmp_path / "good.jsonl")).count() == 150
    for bad in ("[1]", "{", "7", "null", '"x"'):
        (tmp_path / "bad.jsonl").write_text("\n".join([*lines * 30, bad, "{"]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        try:
            with pytest.raises(ValueError, match=r"bad\.jsonl:151$"):
                V.objects(spark, str(tmp_path / "bad.jsonl"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_kinds_are_told_apart(spark):
    values = ["true", "1", "1.5", '"true"', "null", "[]", "{}", "12345678901234567890"]
    df = spark.createDataFrame([(json.dumps({"i": i})[:-1] + f',"v":{v}}}',) for i, v in enumerate(values)] + [('{"i":99}',)], "j string").select(F.parse_json("j").alias("r"))
    got = df.select(V.number(F.col("r"), "$.i").alias("i"), V.kind(V.at(F.col("r"), "$.v")).alias("k"), V.boolean(F.col("r"), "$.v").alias("b"), V.number(F.col("r"), "$.v").alias("n"), V.number(F.col("r"), "$.v", True).alias("m"), V.text(F.col("r"), "$.v").alias("t"), V.empty(F.col("r"), "$.v").alias("e")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("boolean", True, None, 1.0, None, False), ("number", None, 1.0, 1.0, None, False), ("number", None, 1.5, 1.5, None, False), ("string", None, None, None, "true", False), ("null", None, None, None, None, True), ("array", None, None, None, None, True), ("object", None, None, None, None, True), ("number", None, 12345678901234567890.0, 12345678901234567890.0, None, False), (None, None, None, None, None, True)]
