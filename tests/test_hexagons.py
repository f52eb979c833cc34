import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.functions import hexagons as H
from sparkwright.plans import places
from sparkwright.plans.studies import supplier_places

SF = "/root/testdata/sf0.001"


def points(n, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return np.degrees(np.arcsin(v[:, 2])), np.degrees(np.arctan2(v[:, 1], v[:, 0]))


@pytest.mark.parametrize("resolution", [0, 1, 2, 5, 9, 12, 15])
def test_centres_come_back_and_points_are_in_the_nearest_cell(resolution):
    lat, lon = points(4000, resolution)
    cells = H.cells_of(lat, lon, resolution)
    at = H.centres(cells)
    assert (H.cells_of(at[:, 0], at[:, 1], resolution) == cells).all()
    here = H.vectors(lat, lon)
    own = (H.vectors(at[:, 0], at[:, 1]) * here).sum(axis=1)
    around = H.neighbours(cells)
    near = np.stack([(H.vectors(*H.centres(around[:, k]).T) * here).sum(axis=1) for k in range(6)]).max(axis=0)
    assert (np.arccos(np.clip(own, -1, 1)) <= np.arccos(np.clip(near, -1, 1)) * 1.3 + 1e-9).all()  # cells bend towards the corners


@pytest.mark.parametrize("resolution", [0, 1, 2, 3])
def test_all_cells_with_twelve_pentagons_and_mutual_neighbours(resolution):
    found = rim = H.cells_of(np.array([10.0]), np.array([20.0]), resolution)
    while len(rim):
        rim = np.setdiff1d(H.neighbours(rim).ravel(), found)
        found = np.union1d(found, rim)
    assert len(found) == 10 * 7**resolution + 2
    around = {c: set(n) for c, n in zip(found.tolist(), H.neighbours(found).tolist(), strict=True)}
    assert sorted({len(n) for n in around.values()}) == ([5] if resolution == 0 else [5, 6]) and sum(len(n) == 5 for n in around.values()) == 12
    assert all(c in around[n] and n != c for c, near in around.items() for n in near)


def test_disks_and_distances_against_steps_counted_one_by_one():
    lat, lon = points(6, 3)
    for start in H.cells_of(lat, lon, 4).tolist():
        steps, rim = {start: 0}, [start]
        for n in range(1, 7):
            rim = sorted({x for c in rim for x in H.neighbours(np.array([c]))[0].tolist()} - set(steps))
            steps |= dict.fromkeys(rim, n)
        for k in (0, 1, 2, 5):
            assert H.disk(start, k).tolist() == sorted(c for c, s in steps.items() if s <= k)
        assert (len(H.disk(start, 1)), len(H.disk(start, 2))) == (7, 19)
        some = sorted(steps)[:: max(1, len(steps) // 40)]
        assert [H.steps_between(start, c) for c in some] == [steps[c] for c in some]
    a, b = H.cells_of(np.array([0.0, 80.0]), np.array([0.0, 170.0]), 6).tolist()
    assert H.steps_between(a, b, most=5) is None and H.steps_between(a, int(H.cells_of(np.array([0.0]), np.array([0.0]), 5)[0])) is None


def test_boundaries_close_around_the_centre_and_are_shared():
    lat, lon = points(300, 5)
    cells = np.unique(H.cells_of(lat, lon, 3))
    corners = H.boundaries(cells)
    for cell, mine in zip(cells.tolist(), corners, strict=True):
        keys = {tuple(np.round(H.vectors(*c), 9)) for c in mine}
        near = sorted(set(H.neighbours(np.array([cell]))[0].tolist()))
        assert len(keys) == len(near)
        for other in H.boundaries(np.array(near)):
            assert len(keys & {tuple(np.round(H.vectors(*c), 9)) for c in other}) == 2


def test_no_cell_for_what_is_no_place():
    assert H.cells_of(np.array([np.nan, 91.0, 90.0, -90.0]), np.array([0.0, 0.0, np.inf, 400.0]), 5).tolist()[:3] == [0, 0, 0]
    assert H.cells_of(np.array([12.0, 12.0]), np.array([179.9999, 179.9999 - 360]), 9).tolist()[0] == H.cells_of(np.array([12.0]), np.array([179.9999 - 360]), 9)[0]
    with pytest.raises(ValueError, match="resolution"):
        H.cells_of(np.zeros(1), np.zeros(1), 16)


def test_spark_forms(spark):
    df = spark.createDataFrame([(41.9, -87.6), (41.9, -87.6), (None, 1.0), (95.0, 1.0)], "lat double, lon double")
    got = H.with_hexagons(df, "lat", "lon", 7).withColumn("at", H.centre_udf(F.col("cell"))).withColumn("disk", H.disk_udf(F.col("cell"), 1)).withColumn("corners", H.boundary_udf(F.col("cell"))).collect()
    own = int(H.cells_of(np.array([41.9]), np.array([-87.6]), 7)[0])
    assert sorted(str(r["cell"]) for r in got) == sorted([str(own)] * 2 + ["None"] * 2)
    for r in got:
        if r["cell"]:
            assert len(r["disk"]) == 7 and len(r["corners"]) == 6 and abs(r["at"]["lat"] - 41.9) < 0.1
        else:
            assert r["at"] is None and r["disk"] is None and r["corners"] is None


def test_query_against_cells_one_by_one(spark):
    activity = {}
    for r in supplier_places(spark, SF).collect():
        c = int(H.cells_of(np.array([r["latitude"]]), np.array([r["longitude"]]), 8)[0])
        n, a = activity.get(c, (0, 0))
        activity[c] = (n + 1, a + r["activity"])
    got = places.hexagon_activity(spark, SF).collect()
    assert {r["cell"]: (r["places"], r["activity"]) for r in got} == activity and len(got) == len(activity)
    for r in got:
        near = {k: [activity[c][1] for c in activity if H.steps_between(r["cell"], c) == k] for k in (1, 2)}
        assert (r["ring_1"], r["cells_1"], r["ring_2"], r["cells_of_ring_2"]) == (sum(near[1]), len(near[1]), sum(near[2]), len(near[2]))
