import math
import re
from itertools import permutations

import numpy as np

from sparkwright.llm.filter_audit import filter_audit, within

from .helpers import documents, empty, frame


def fails(text, repeated):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": repeated}


def brute(rows, labels):
    """Every order, every step, document by document."""
    texts = [(d, t or "", s or "") for d, t, _, s in rows]
    first = {}
    for d, t, _ in texts:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    docs = [(s, {f for f, bad in fails(t, d is not None and d > first[t]).items() if bad}, (d, 1) in {(x, q) for x, q, _ in labels}, (d, 1) in {(x, y) for x, _, y in labels}) for d, t, s in texts]
    out, total = {}, {}
    for part in {s for s, *_ in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone, alive = [d for d in alive if f in d[1]], [d for d in alive if f not in d[1]]
                bad = [d for d in mine if f in d[1]]
                out[part, "".join(order), step] = (len(alive), len(gone), len(bad) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_against_document_by_document(spark):
    rows = documents(2)
    rows += [(900 + i, f"Some Words# {i % 3} " * 20, "en", f"s{i % 2}") for i in range(12)] + [(950, "WORD " * 60, "en", ""), (951, "one " * 49 + "two", "en", None), (952, "\U0001f600 A|" * 3, None, "s1"), (900, "Some Words# 0 " * 20, "en", "s0")]
    rows += [(None, "Some Words# 1 " * 20, "en", "s1"), (None, "only without an id " * 20, "en", "s1")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(901, 1, None), (901, 0, 1), (903, None, None), (None, 1, 1), (99_999, 1, 1)]
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit(frame(spark, rows), marks).collect()}
    assert got == brute(rows, [x for x in labels if x[0] is not None])


def test_empty_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty(spark), marks).count() == 0
    got = filter_audit(frame(spark, [(1, None, None, None)]), marks).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and {(r["kept"], r["removed"]) for r in got if r["filter_order"][r["step"] - 1] == "A"} == {(0, 1)}


def test_transform_sums_over_subsets():
    counts = np.arange(2 * 32).reshape(2, 32) ** 2
    got = within(counts)
    for mask in range(32):
        assert (got[:, mask] == sum(counts[:, m] for m in range(32) if m & mask == m)).all()


def test_shapley_of_all_orders_is_what_is_removed(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit(frame(spark, documents(4)), marks).filter("filter_order = 'ABCDE'").collect()
    for part in {r["part"] for r in rows}:
        mine = [r for r in rows if r["part"] == part]
        assert sum(r["shapley"] for r in mine) == math.factorial(5) * sum(r["removed"] for r in mine)
