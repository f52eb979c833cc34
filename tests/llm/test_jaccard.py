import random

import numpy as np
import pytest

from sparkwright.llm import components, jaccard
from sparkwright.llm.jaccard import EPS, groups_in, jaccard_components

from .helpers import documents, empty, frame


def brute(rows, k=5):
    sets = []
    for _, text, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_against_all_pairs(spark):
    rows = documents()
    assert result(jaccard_components(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("limit", [4, 12])
def test_large_regions_are_split_and_lose_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "SETS", limit)
    rng = random.Random(limit)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(40):  # near copies of one text, and of copies of it
        base = base if i % 9 else [f"w{rng.randrange(10**6)}" if rng.random() < 0.1 else x for x in base]
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    assert result(jaccard_components(frame(spark, rows))) == brute(rows)


def test_region_groups_with_pivots():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        for _ in range(25):
            keep = base[rng.random(60) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 8), dtype=np.uint64)])))
    got = groups_in(sets)
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 1 - c / (len(sets[i]) + len(sets[j]) - c) <= EPS + 1e-12:
                root[root == root[i]] = root[j]
    assert len(set(zip(got.tolist(), root.tolist(), strict=True))) == len(set(got.tolist())) == len(set(root.tolist()))


def test_cells_decide_what_meets(monkeypatch):
    rng = np.random.default_rng(2)
    common = rng.integers(0, 1 << 60, 20, dtype=np.uint64)  # all sets share some, so one region holds them
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, 80, dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: 100 - i], rng.integers(0, 1 << 60, i, dtype=np.uint64)])) for s in sets for i in (3, 6)]
    met = set()
    whole = jaccard.measured

    def watched(here, pivots):
        met.update((s.tobytes(), p.tobytes()) for s in here for p in pivots if s is not p)
        return whole(here, pivots)

    monkeypatch.setattr(jaccard, "measured", watched)
    root = groups_in(sets)
    assert len(set(root.tolist())) == 40 and len(met) < 0.6 * len(sets) * (len(sets) - 1) / 2


def test_cells_lose_no_pair_and_pivots_need_not_be_near():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - i], rng.integers(0, 1 << 60, i, dtype=np.uint64)])) for i in range(0, 100, 2) for _ in range(3)]
    d, _ = jaccard.measured(sets, [sets[0], sets[60], rng.integers(0, 1 << 60, 50, dtype=np.uint64)])
    inside, far = jaccard.cells(d)
    for i, s in enumerate(sets):
        near = jaccard.measured(sets, [s])[1][:, 0]
        together = (inside & inside[i]).any(axis=1) | (far & far[i])
        assert together[near].all()


@pytest.mark.parametrize("copies", [1, 4])
def test_texts_that_share_by_chance_have_no_region(spark, monkeypatch, copies):
    monkeypatch.setattr(jaccard, "HEAVY", 0)  # as in a corpus with more frequent shingles than are known one by one
    made, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: made.append(name) or cut(df, name))
    passage = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(31)]
    texts = [" ".join([passage[i], *(f"w{i}x{j}" for j in range(40)), passage[i + 1]]) for i in range(30)]
    rows = [(100 * c + i, text, "en", "s") for c in range(copies) for i, text in enumerate(texts)]
    assert result(jaccard_components(frame(spark, rows))) == brute(rows)
    assert "attached" in made and "members" not in made


def test_far_sets_of_a_large_region_meet_only_where_they_are_attached(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SETS", 4)
    copied, groups = [], jaccard.region_groups
    monkeypatch.setattr(jaccard, "region_groups", lambda members: copied.append(members.count()) or groups(members))
    rng, rows = random.Random(11), []
    order = rng.sample(range(160), 160)
    passages = [[f"p{j}x{k}" for k in range(40)] for j in range(160)]  # each in two of the texts, which have nothing else, and in near copies of them
    for i in range(160):
        w = passages[order[i]] + passages[order[i - 1]]
        rows += [(10 * i, " ".join(w), "en", "s"), (10 * i + 1, " ".join([*w[:-1], f"end{i}"]), "en", "s")]
    assert result(jaccard_components(frame(spark, rows))) == brute(rows)
    assert 0 < sum(copied) < 10 * len(rows), copied


@pytest.mark.parametrize("room", [1, 27])
def test_marks_tell_how_many_sets_hold_a_shingle(spark, monkeypatch, room):
    monkeypatch.setattr(jaccard, "ROOM", room)
    rng = np.random.default_rng(5)
    of = [np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(24)) for n in (300, 200, 100)]  # held by one, two, five sets
    v, c = np.concatenate(of), np.repeat([1, 2, 5], [300, 200, 100])
    v, c = v[order := np.argsort(v)], c[order]
    rows = [(b, jaccard.pack(np.diff(v[i:j], prepend=np.uint64(0)), c[i:j].astype("<u2"))) for b, i, j in jaccard.by_bucket(v << np.uint64(24), 6)]
    known = jaccard.heavy_shingles(spark.createDataFrame(rows, "bucket int, blob binary"), 6)
    got = [jaccard.commonness(x << np.uint64(24), *known) for x in of]
    assert len(known[0]) == 100 and (got[2] == int(4 * np.log2(5)) - jaccard.THRICE + 3).all()
    assert (got[1] >= 1).all() and (room == 1 or ((got[1] == 1).mean() > 0.8 and (got[0] == 0).mean() > 0.6))


def test_components_of_a_forest_of_the_links(spark, monkeypatch):
    made, cut = {}, components.cut
    monkeypatch.setattr(components, "cut", lambda df, name: made.setdefault(name, cut(df, name)) if name == "links" else cut(df, name))
    monkeypatch.setattr(components, "forget", lambda *tables: None)
    dense = [(i, j) for i in range(0, 80, 2) for j in range(i + 2, 80, 2)]
    path = [(2 * i + 1, 2 * i + 3) for i in range(30)]
    got = components.components(spark.createDataFrame([*dense, *path, *path, (500, 500)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(0, 80, 2)} | {2 * i + 1: 1 for i in range(31)} | {500: 500}
    assert len(got) == 72 and made["links"].count() < 2 * 72


def test_names_that_two_fingerprints_share(spark):
    own = spark.createDataFrame([(1, 5, 10), (2, 5, 11), (3, 5, 10), (4, 6, 10), (5, None, None)], "doc_id long, low long, high long")
    node = {r["doc_id"]: r["node"] for r in jaccard.named(own, jaccard.shared_names(own)).collect()}
    assert node[1] == node[3] != node[2] and node[4] == 6 and node[5] is None and len(set(node.values())) == 4


def test_empty(spark):
    assert jaccard_components(empty(spark)).collect() == []
