"""Hexagonal cells of the earth: an icosahedron's faces, each with a lattice of hexagons, seven children to a cell.

A point is projected from the centre to the plane of the nearest face. There it has coordinates x + y*Z with Z = a sixth
of a turn, the face's corners being 0, 1 and Z; times the edge E of the resolution (an Eisenstein integer of norm
7**resolution, turned one way and back in turn, so that every second resolution stands straight) the cells' centres are
the integers a + b*Z, and a point's cell is the nearest. Corners of faces are lattice points, so the lattices of two faces
continue each other across their edge, and a cell over an edge has one identity: the face that holds its centre (of
several the first). Whether it does, and its place on the next face, are whole-number questions. The twelve cells at the
corners are pentagons.

A cell is a long: resolution (4 bits), face (5), a and b (27 each, from 2**26). There are 10 * 7**resolution + 2 cells of
a resolution; those of 10 have about a sixth of a square kilometre. All functions take and give numpy arrays; those named ``..._udf`` are their Spark forms.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, HALF = 15, 1 << 26
EARTH_KM = 6371.0088
UNITS = np.array([(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)])


def times(a, b, c, d):
    """(a + b*Z) * (c + d*Z), as Z*Z = Z - 1."""
    return a * c - b * d, a * d + b * c + b * d


def conjugate(a, b):
    return a + b, -b


def edge(resolution: int) -> tuple[int, int]:
    """The side of a face in steps of the lattice."""
    e = (1, 0)
    for i in range(resolution):
        e = times(*e, *((2, 1) if i % 2 == 0 else conjugate(2, 1)))
    return e


def icosahedron() -> tuple[np.ndarray, np.ndarray]:
    """Corners, and the faces' corners, counterclockwise from outside."""
    g = (1 + 5**0.5) / 2
    v = np.array([p for s in (-1, 1) for t in (-g, g) for p in ((0, s, t), (s, t, 0), (t, 0, s))], float)
    v /= np.linalg.norm(v[0])
    near = np.linalg.norm(v[0] - v, axis=1)
    side = np.sort(near)[1] * 1.01
    close = np.linalg.norm(v[:, None] - v[None], axis=2) < side
    faces = [t for t in combinations(range(12), 3) if all(close[i, j] for i, j in combinations(t, 2))]
    return v, np.array([t if np.linalg.det(v[list(t)]) > 0 else (t[0], t[2], t[1]) for t in faces])


VERTICES, FACES = icosahedron()
CORNER = VERTICES[FACES]
NORMAL = np.cross(CORNER[:, 1] - CORNER[:, 0], CORNER[:, 2] - CORNER[:, 0])
NORMAL /= np.linalg.norm(NORMAL, axis=1)[:, None]
HEIGHT = (NORMAL * CORNER[:, 0]).sum(axis=1)
#: For each face the vectors whose products with a point of the plane, less the first corner, are its x and y.
DUAL = np.array([np.linalg.pinv(np.stack([c[1] - c[0], c[2] - c[0]], axis=1)) for c in CORNER])
PLACES = [(0, 0), (1, 0), (0, 1)]
#: The first face of each of the twelve corners, and which of its corners it is.
FIRST = np.array([np.argwhere(FACES == v)[0] for v in range(12)])
#: The corners at the ends of the edges that x + y*Z leaves by y < 0, by x < 0, and by x + y > 1.
EDGES = [(0, 1), (0, 2), (1, 2)]


def crossings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each face and edge: the next face, and the turn and shift that take places of the one to the other."""
    to, turn, shift = np.zeros((20, 3), int), np.zeros((20, 3, 2), int), np.zeros((20, 3, 2), int)
    for f in range(20):
        for k, (p, q) in enumerate(EDGES):
            shared = {FACES[f, p], FACES[f, q]}
            g = next(g for g in range(20) if g != f and shared <= set(FACES[g].tolist()))
            there = [PLACES[FACES[g].tolist().index(FACES[f, i])] for i in (p, q)]
            d, e = np.subtract(PLACES[q], PLACES[p]), np.subtract(there[1], there[0])
            a = times(*e, *conjugate(*d))  # d is a unit, so this is e / d
            to[f, k], turn[f, k], shift[f, k] = g, a, np.subtract(there[0], times(*a, *PLACES[p]))
    return to, turn, shift


TO, TURN, SHIFT = crossings()


def settled(face, a, b, e: tuple[int, int], one: bool = True):
    """The places, moved on to the face that holds them; with ``one``, of the faces that share one the first."""
    face, a, b = np.array(face, int), np.array(a, np.int64), np.array(b, np.int64)
    norm, back = times(*e, *conjugate(*e))[0], conjugate(*e)

    def cross(at, k):
        f = face[at]
        x, y = times(TURN[f, k, 0], TURN[f, k, 1], a[at], b[at])
        s, t = times(SHIFT[f, k, 0], SHIFT[f, k, 1], *e)
        face[at], a[at], b[at] = TO[f, k], x + s, y + t

    for _ in range(6):
        x, y = times(a, b, *back)
        out = np.select([y < 0, x < 0, x + y > norm], [0, 1, 2], -1)
        at = np.flatnonzero(out >= 0)
        if not len(at):
            break
        cross(at, out[at])
    if one:
        x, y = times(a, b, *back)
        for p, on in enumerate(((x == 0) & (y == 0), (x == norm) & (y == 0), (x == 0) & (y == norm))):
            at = np.flatnonzero(on)
            first = FIRST[FACES[face[at], p]]
            places = np.array(PLACES)[first[:, 1]]
            face[at] = first[:, 0]
            a[at], b[at] = times(places[:, 0], places[:, 1], *e)
        x, y = times(a, b, *back)
        corner = (np.stack([x, y, norm - x - y]) == 0).sum(axis=0) > 1
        side = np.select([y == 0, x == 0, x + y == norm], [0, 1, 2], -1)
        at = np.flatnonzero((side >= 0) & ~corner)
        at = at[TO[face[at], side[at]] < face[at]]
        cross(at, side[at])
    return face, a, b


def packed(resolution: int, face, a, b) -> np.ndarray:
    return (np.int64(resolution) << 59) | (face.astype(np.int64) << 54) | ((a + HALF) << 27) | (b + HALF)


def unpacked(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Resolution, face, a, b."""
    cells, low = np.asarray(cells, np.int64), np.int64((1 << 27) - 1)
    return (cells >> 59).astype(int), ((cells >> 54) & 31).astype(int), ((cells >> 27) & low) - HALF, (cells & low) - HALF


def vectors(lat, lon) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def cells_of(lat: np.ndarray, lon: np.ndarray, resolution: int) -> np.ndarray:
    """The cell of each point in degrees; 0 is no cell: for numbers that are not finite or latitudes beyond the poles."""
    if not 0 <= resolution <= MOST:
        raise ValueError(f"resolution is 0 to {MOST}")
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    good = np.isfinite(lat) & np.isfinite(lon) & (np.abs(np.where(np.isfinite(lat), lat, 0)) <= 90)
    p = vectors(np.where(good, lat, 0.0), np.where(good, lon, 0.0))
    face = (p @ NORMAL.T).argmax(axis=1)
    p *= (HEIGHT[face] / (p * NORMAL[face]).sum(axis=1))[:, None]
    z = np.einsum("nij,nj->ni", DUAL[face], p - CORNER[face, 0])
    e = edge(resolution)
    s, t = times(z[:, 0], z[:, 1], *map(float, e))
    a, b, c = np.rint(s), np.rint(t), np.rint(-s - t)
    da, db, dc = np.abs(a - s), np.abs(b - t), np.abs(c + s + t)
    a, b = np.where((da > db) & (da > dc), -b - c, a), np.where((db >= da) & (db > dc), -a - c, b)
    return np.where(good, packed(resolution, *settled(face, a, b, e)), 0)


def by_resolution(cells: np.ndarray, run, empty) -> np.ndarray:
    """``run`` (resolution, face, a, b) over the cells of each resolution, put back in order."""
    resolution, face, a, b = unpacked(cells)
    out = None
    for r in np.unique(resolution):
        at = np.flatnonzero(resolution == r)
        part = run(int(r), face[at], a[at], b[at])
        if out is None:
            out = np.zeros((len(cells), *part.shape[1:]), part.dtype)
        out[at] = part
    return empty if out is None else out


def located(face, a, b, e: tuple[int, int]) -> np.ndarray:
    """Latitude and longitude of places."""
    x, y = (v / times(*e, *conjugate(*e))[0] for v in times(a, b, *conjugate(*e)))
    p = CORNER[face, 0] + x[:, None] * (CORNER[face, 1] - CORNER[face, 0]) + y[:, None] * (CORNER[face, 2] - CORNER[face, 0])
    p /= np.linalg.norm(p, axis=1)[:, None]
    return np.degrees(np.stack([np.arcsin(np.clip(p[:, 2], -1, 1)), np.arctan2(p[:, 1], p[:, 0])], axis=1))


def centres(cells: np.ndarray) -> np.ndarray:
    return by_resolution(cells, lambda r, f, a, b: located(f, a, b, edge(r)), np.zeros((0, 2)))


def boundaries(cells: np.ndarray) -> np.ndarray:
    """Six corners of each cell; a pentagon's come with one of them twice."""

    def run(r, f, a, b):
        e = tuple(3 * x for x in edge(r))
        out = []
        for k in range(6):
            u = UNITS[k] + UNITS[(k + 1) % 6]
            out.append(located(*settled(f, 3 * a + u[0], 3 * b + u[1], e, one=False), e))
        return np.stack(out, axis=1)

    return by_resolution(cells, run, np.zeros((0, 6, 2)))


def neighbours(cells: np.ndarray) -> np.ndarray:
    """Six cells around each, a pentagon's five with one of them twice."""
    return by_resolution(cells, lambda r, f, a, b: np.stack([packed(r, *settled(f, a + u[0], b + u[1], edge(r))) for u in UNITS], axis=1), np.zeros((0, 6), np.int64))


def disk(cell: int, k: int) -> np.ndarray:
    """The cells at most ``k`` steps away, itself included, ascending."""
    found = edge_ = np.array([cell], np.int64)
    for _ in range(k):
        edge_ = np.setdiff1d(neighbours(edge_).ravel(), found)
        found = np.union1d(found, edge_)
    return found


def steps_between(left: int, right: int, most: int = 64) -> int | None:
    """How many steps lead from one cell to the other; none for different resolutions, or for more than ``most`` steps
    between different faces (on one face the lattice tells at once)."""
    r, f, a, b = (x.tolist() for x in unpacked(np.array([left, right])))
    if r[0] != r[1]:
        return None
    if f[0] == f[1]:
        return max(abs(a[0] - a[1]), abs(b[0] - b[1]), abs(a[0] + b[0] - a[1] - b[1]))
    seen = [np.array([left], np.int64), np.array([right], np.int64)]
    rim, n = list(seen), 0
    while n < most:
        i = n % 2
        rim[i] = np.setdiff1d(neighbours(rim[i]).ravel(), seen[i])
        seen[i] = np.union1d(seen[i], rim[i])
        n += 1
        if len(np.intersect1d(rim[i], rim[1 - i])):
            return n
    return None


# Spark forms

def cell_udf(lat: Column, lon: Column, resolution: int) -> Column:
    """The cell as a long; null where there is none."""

    @F.pandas_udf("long")
    def run(y: pd.Series, x: pd.Series) -> pd.Series:
        got = pd.Series(cells_of(y.to_numpy(float), x.to_numpy(float), resolution)).astype("Int64")
        return got.mask(got == 0)

    return run(lat.cast("double"), lon.cast("double"))


def known(cell: Column) -> Column:
    """The cell, 0 for null: a column with nulls would come to pandas as floats, which don't hold these numbers."""
    return F.coalesce(cell, F.lit(0).cast("long"))


def centre_udf(cell: Column) -> Column:
    @F.pandas_udf("struct<lat:double,lon:double>")
    def run(c: pd.Series) -> pd.DataFrame:
        got = centres(c.to_numpy(np.int64))
        return pd.DataFrame({"lat": got[:, 0], "lon": got[:, 1]})

    return F.when(cell.isNotNull(), run(known(cell)))


def boundary_udf(cell: Column) -> Column:
    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([[{"lat": y, "lon": x} for y, x in corners] for corners in boundaries(c.to_numpy(np.int64)).tolist()])

    return F.when(cell.isNotNull(), run(known(cell)))


def disk_udf(cell: Column, k: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([disk(x, k).tolist() if x else [] for x in c.to_numpy(np.int64).tolist()])

    return F.when(cell.isNotNull(), run(known(cell)))


def with_hexagons(df: DataFrame, lat: str, lon: str, resolution: int, name: str = "cell") -> DataFrame:
    """``df`` with the cell of each row's place: the places are made distinct first, so each is computed once."""
    places = df.select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).filter("__lat is not null and __lon is not null").distinct()
    found = places.withColumn(name, cell_udf(F.col("__lat"), F.col("__lon"), resolution))
    return df.join(found, (df[lat] == found["__lat"]) & (df[lon] == found["__lon"]), "left").drop("__lat", "__lon")


def smoothed(counts: DataFrame, cell: str, value: str, k: int = 1) -> DataFrame:
    """cell, value, near (sum over the other cells at most ``k`` steps away), near_cells (how many of those have a value)."""
    around = counts.select(F.col(cell).alias("__c"), F.col(value).alias("__v"), F.explode(disk_udf(F.col(cell), k)).alias(cell)).filter(F.col("__c") != F.col(cell))
    near = around.groupBy(cell).agg(F.sum("__v").alias("near"), F.count("*").alias("near_cells"))
    return counts.select(cell, value).join(near, cell, "left").na.fill(0, ["near", "near_cells"])
