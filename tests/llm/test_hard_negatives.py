import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, slice string, part int, v int"
SHIFT = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def brute(rows, every=50, k=5, n=3):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = set()
    for a, (q, label) in ok.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, v, strict=True)) for i, (v, _) in ok.items() if i != a}
        for p in sorted((i for i in score if ok[i][1] == label), key=lambda i: (-score[i], i))[:k]:
            fit = sorted((i for i in score if ok[i][1] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]), key=lambda i: (-score[i], i))[:n]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit, 1)}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "clash", 1, 2) for i, v, label in rows], SCHEMA)
    got = [tuple(r) for r in H.hard_negatives(df, shifted=F.expr(SHIFT), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, d))
    return [(i, [float(np.float32(x)) for x in (centres[i % labels] + rng.standard_normal(d)) / math.sqrt(d)], i % labels) for i in range(n)]


@pytest.mark.parametrize("slices", [1 << 21, 24 * 100])
def test_equals_all_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(H, "SLICE", slices)
    rows = vectors(1, 900, 24)
    rows += [(2000 + i, rows[100][1], i % 2) for i in range(120)] + [(3000 + i, rows[50][1], 2) for i in range(9)] + [(4000, [0.0] * 24, 1), (4050, [0.0] * 24, 2), (4100, [-x for x in rows[0][1]], 3)]
    bad = [(5000, None, 1), (5050, rows[1][1], None), (5100, [], 1), (5150, [1.0] * 23 + [None], 2), (5200, [float("nan")] + [1.0] * 23, 1), (5250, [float("inf")] + [1.0] * 23, 1), (None, rows[0][1], 0), (5300, [1.0] * 5, 1)]
    want = brute([*rows, *bad[:-1]])
    assert want and mined(spark, [*rows, *bad, rows[0], rows[150]]) == want


def test_large_components_and_whole_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) * 40_000.5], int(rng.integers(0, 3))) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_none_and_few(spark):
    assert mined(spark, [(1, None, 1)]) == set()
    assert mined(spark, [(50, [1.0, 0.0], 1)]) == set()
    assert mined(spark, [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (53, [0.75, 0.0], 3), (54, [0.25, 0.0], 2)]) == {(50, 51, 1, 52, 65536, 49152), (50, 51, 2, 53, 65536, 49152)}


def test_bounds_hold_and_drop():
    rows = np.array([[math.floor(256 * x) for x in v] for _, v, _ in vectors(3, 2000, 48)])
    turn = H.rotation(rows.astype(float))
    q, x = H.Turned(rows[:10], turn), H.Turned(rows, turn)
    exact = rows[:10] @ rows.T
    low = np.sort(exact, axis=1)[:, -20].astype(float)
    of, row = H.survivors(q, x, low, np.full(10, np.inf), H.slack(turn))
    wanted = {(a, b) for a, b in zip(*np.nonzero(exact >= low[:, None]), strict=True)}
    assert wanted <= set(zip(of.tolist(), row.tolist(), strict=True)) and len(of) < 3 * len(wanted)
    assert (H.products(rows[:10], rows, of, row) == exact[of, row]).all()
