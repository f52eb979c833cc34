import random

import pytest

from sparkwright.llm.mixing import mix_plan, mixed, source_targets

from .helpers import documents, empty, frame


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) >= most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left, free = left - sum(out[s] for s in over), free - over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, None: 500, "é": 30, "Z": 0}, {"only": 7}, {f"s{i:02d}": (i * 37) % 101 for i in range(25)}, {"x": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_plan_and_mix_agree(spark):
    rows = [r for s in range(4) for r in documents(s)]
    df = frame(spark, [(None if r[0] is None else r[0] + 1000 * (i // 100), *r[1:]) for i, r in enumerate(rows)])
    plan, again = mix_plan(df).collect(), mix_plan(df.repartition(7)).collect()
    assert sorted(plan, key=str) == sorted(again, key=str) and len(plan) == len(rows)
    total, target = {}, {}
    for r in plan:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        key = (r["source_size"], r["target"])
        total[key] = total.get(key, 0) + r["taken"]
    out = mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in plan)
    assert sum(len((r["text"] or "").encode().split()) for r in out.select("text").collect()) == sum(r["taken"] for r in plan)


@pytest.mark.parametrize("n", [50, 300])
def test_sources_of_fifty_documents_come_within_a_twentieth_of_their_target(spark, n):
    rng = random.Random(n)
    rows = [(i, " ".join(["w"] * min(5000, int(rng.lognormvariate(4, 1)))), "en", f"s{i % 12:02d}") for i in range(12 * n)]
    taken, target = {}, {}
    for r in mix_plan(frame(spark, rows)).collect():
        key = rows[r["doc_id"]][3]
        taken[key] = taken.get(key, 0) + r["taken"]
        target[key] = r["target"]
    assert all(abs(taken[k] / target[k] - 1) < 0.05 for k in target), {k: taken[k] / target[k] for k in target}


def test_columns_of_any_name_and_words(spark):
    rows = [(i, f"one two\u00a0x\t{i}\x0bfour\x1cfive", f"s{i % 2}", 1, 2, 3.5) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __rate int, own_0 int, `a.b` double")
    out = mixed(df)
    assert out.columns == df.columns and {(r["__rate"], r["own_0"], r["a.b"]) for r in out.collect()} == {(1, 2, 3.5)}
    assert {r["size"] for r in mix_plan(df).collect()} == {4}


def test_empty(spark):
    assert mix_plan(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0
