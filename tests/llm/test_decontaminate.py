import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from sparkwright.llm.decontaminate import MASKS, contaminations, decontaminated, kept, longest_stretch

from .helpers import documents, empty, frame


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_longest_stretch_is_the_longest():
    rng = random.Random(0)
    for _ in range(300):
        e = [rng.random() < 0.7 for _ in range(rng.randrange(0, 30))]
        best = max((z - a for a in range(len(e)) for z in range(a + 1, len(e) + 1) if 5 * sum(e[a:z]) >= 4 * (z - a)), default=0)
        a, z = longest_stretch(e)
        assert z - a == best and 5 * sum(e[a:z]) >= 4 * (z - a)


def test_masks_miss_no_accepted_pattern():
    for n in range(12, 26):
        spots = [sum(1 << at + i for i in kept(m)) for m in MASKS for at in range(n - len(m) + 1)]
        for k in range(n // 5 + 1):
            assert all(any(not s & changed for s in spots) for changed in (sum(1 << i for i in c) for c in combinations(range(n), k))), (n, k)


def test_short_items_with_any_fifth_changed(spark):
    for n in (4, 5, 9, 10, 11, 12, 13):
        w = [f"w{n}x{i}" for i in range(n)]
        docs = [(k, " ".join([f"before{k}"] + ["new" if i in c else x for i, x in enumerate(w)] + [f"after{k}"])) for k, c in enumerate(combinations(range(n), n // 5))]
        got = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, [(1, " ".join(w))])).collect()
        assert {r["doc_id"] for r in got} == set(range(len(docs)))


def words(text):
    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", (text or "").lower())


def brute(docs, tests, least=13):
    """Every diagonal of every document and item: the longest stretch of which four fifths are equal, then the most equal words, then the first."""
    found = {}
    for d, text, *_ in docs:
        for i, item in tests:
            a, b = words(text), words(item)
            best = (0, 0, 0)
            for shift in range(1 - len(b), len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                e = [a[shift + k] == b[k] for k in range(lo, hi)]
                if sum(e) < 0.8 * min(least, len(b)):
                    continue
                x, z = longest_stretch(e)
                best = max(best, (z - x, sum(e[x:z]), -(shift + lo + x)))
            if b and best[0] >= min(least, len(b)):
                key = (d, i)
                found[key] = max(found.get(key, (0, 0, 0)), best)
    return {k: (-at, n, same) for k, (n, same, at) in found.items()}


def test_against_all_diagonals(spark):
    rng = random.Random(5)
    w = [[f"t{rng.randrange(5000)}" for _ in range(n)] for n in (40, 20, 8)]
    tests = [(1, " ".join(w[0])), (2, " ".join(w[1])), (3, " ".join(w[2])), (4, None), (5, ""), (6, " ".join(w[0]).upper()), (7, "!!"), (None, " ".join(w[1][::-1])), (8, "again " * 15), (9, "solo")]
    noise = lambda n: [f"d{rng.randrange(10**6)}" for _ in range(n)]
    near = list(w[0])
    for i in (7, 16, 25, 33):
        near[i] = "other"
    docs = [(100, " ".join(noise(50) + w[0] + noise(50))), (101, " ".join(noise(10) + near)), (102, ", ".join(w[1]).title()), (103, " ".join(noise(5) + w[2] + noise(5))), (104, " ".join(w[2][:7] + noise(30))), (105, " ".join(w[0][:12])), (106, " ".join(noise(5) + w[0][10:24] + noise(5))), (107, None), (108, ""), (109, " ".join(noise(300)))]
    docs += [(110, " ".join(w[1][::-1] + noise(3) + w[1])), (111, "again " * 40), (112, "a solo b"), (113, " ".join(w[0][:13] + noise(1) + w[0][14:27])), (100, docs[0][1])]
    docs += [(200 + k, " ".join(x if rng.random() > 0.22 else "q" for x in rng.choice(w))) for k in range(40)]
    rows = [(i, t, "en", "s") for i, t in docs] + [(r[0] and r[0] + 1000, *r[1:]) for r in documents() if len(r[1] or "") < 5000]
    df = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): (r["at"], r["overlap_words"], r["equal_words"]) for r in contaminations(df, items(spark, tests)).collect()}
    want = brute(rows, tests)
    assert got == want and {100, 101, 102, 103, 104, 106, 110, 111, 112, 113} <= {d for d, _ in want} and not {105, 107, 108, 109} & {d for d, _ in want}
    clean = decontaminated(df.withColumns({"own_0": F.lit(1), "__print": F.lit("x")}), items(spark, tests))
    assert clean.columns == [*df.columns, "own_0", "__print"]
    bad = {d for d, _ in want}
    assert sorted(map(str, ((r["doc_id"], r["__print"]) for r in clean.collect()))) == sorted(str((r[0], "x")) for r in rows if r[0] not in bad)


def test_empty(spark):
    none = items(spark, [])
    assert contaminations(empty(spark), items(spark, [(1, "a b c")])).count() == 0
    assert contaminations(frame(spark, documents()), none).count() == 0
    assert decontaminated(frame(spark, documents()), none).count() == len(documents())
