import numpy as np

from sparkwright.llm.nearest import nearest, rotation, scan

SCHEMA = "vec_id long, embedding array<float>, key string, list int"


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted(((-float((x * q).sum()), j) for j, x in ok if j != i))[:k]
    return out


def test_recall_order_and_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(24)]) for i in range(1200)]
    rows += [(2000 + i, rows[40][1]) for i in range(60)] + [(3000, None), (3020, []), (3040, [0.0] * 24), (3060, [1.0] * 23 + [None]), (3080, [float("nan")] + [1.0] * 23), (3100, [float("inf")] + [1.0] * 23), (None, rows[0][1]), (3120, [1.0] * 5)]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute([r for r in rows if r[0] != 3120])
    assert set(got) == set(want)
    vectors = {i: np.array(v, float) for i, v in rows if v and i is not None and None not in v}
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        listed = [ranks[r] for r in sorted(ranks)]
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float((vectors[q] * vectors[v]).sum())) < 1e-12 for v, s in listed)
        hits += len({v for v, _ in listed} & {j for _, j in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    same = [v for v, _ in (got[40][r] for r in range(1, 21))]
    assert same == [2000 + i for i in range(20)]


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in nearest(df).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert nearest(df.filter("vec_id < 0")).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    turn, x, q = rotation(48), rng.standard_normal((3000, 48)), rng.standard_normal((20, 48))
    x[:40] += 3 * q[0]  # for some queries the test leaves few alive
    of, row = scan(x @ turn, q @ turn, 20)
    lost = 0
    for i in range(20):
        true = np.argsort(((x - q[i]) ** 2).sum(axis=1))[:20]
        lost += len(set(true.tolist()) - set(row[of == i].tolist()))
    assert lost <= 8 and len(row) < 20 * 60
    few = scan(x[:5] @ turn, q @ turn, 20)
    assert len(few[0]) == 100
