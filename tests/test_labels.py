from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from placewise.operators.labels import place_labels
from placewise.operators.neighbors import delaunay_edges, delaunay_triangles, neighbours
from placewise.operators.triangulate import Triangulation
from placewise.plans.mapspec import map_spec


def _points(spark, rows):
    return spark.createDataFrame(rows, "g int, id long, x double, y double")


def _labels(spark, rows, **k):
    return {r["id"]: (r["halign"], r["valign"], r["hoffset"], r["voffset"]) for r in place_labels(_points(spark, rows), **k).collect()}


def test_one_and_two_points(spark):
    assert _labels(spark, [(0, 1, 0.0, 0.0)]) == {1: ("left", "bottom", 1, 1)}
    assert _labels(spark, [(0, 1, 1.0, 3.0), (0, 2, 2.0, 4.0)]) == {1: ("left", "bottom", 1, 1), 2: ("right", "top", -1, -1)}


def test_points_at_one_place_share_a_label_and_bad_ones_have_none(spark):
    got = _labels(spark, [(0, 1, 0.0, 0.0), (0, 2, -0.0, 0.0), (0, 3, math.nan, 0.0), (0, 4, None, 1.0)])
    assert got == {1: ("left", "bottom", 1, 1), 2: ("left", "bottom", 1, 1)}


def test_isolated_points_turn_away(spark):
    # two close together, one far off: each of the pair is labelled away from the other
    got = _labels(spark, [(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 50.0, 40.0)])
    assert got[1][:2] == ("right", "center") and got[2][0] == "left"


def test_special_edge_sets(spark):
    edges = lambda rows: sorted((r["i"], r["j"]) for r in delaunay_edges(_points(spark, rows)).collect())
    assert edges([(0, 1, 0.0, 0.0), (0, 2, 1.0, 1.0)]) == [(1, 2)]
    assert edges([(0, i, float(i), float(i)) for i in range(5)]) == [(i, i + 1) for i in range(4)]
    assert edges([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 1.0, 1.0), (0, 4, 0.0, 1.0)]) == [(1, 2), (1, 4), (2, 3), (3, 4)]
    assert edges([(0, 1, 0.0, 0.0)]) == []


def _every_pair(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Each pair held against all points: the cotangents of the angles under which the nearest ones on both sides see it."""
    n, found = len(x), []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        dx, dy = (x[j] - x[i])[:, None], (y[j] - y[i])[:, None]
        cross = dx * (y[None, :] - y[i]) - dy * (x[None, :] - x[i])
        dot = (x[i] - x[None, :]) * (x[j][:, None] - x[None, :]) + (y[i] - y[None, :]) * (y[j][:, None] - y[None, :])
        others = np.ones_like(cross, bool)
        others[:, i] = False
        others[np.arange(len(j)), j] = False
        between = (others & (cross == 0) & (dot < 0)).any(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(others & (cross > 0), dot / cross, np.inf).min(axis=1)
            right = np.where(others & (cross < 0), -dot / cross, np.inf).min(axis=1)
        keep = ~between & (np.isinf(left) | np.isinf(right) | (left + right > 0))
        found += [(i, int(b)) for b in j[keep]]
    return found


def _edges(x, y):
    return Triangulation(np.asarray(x, float), np.asarray(y, float)).edges()


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(3, 120), st.integers(0, 10_000), st.sampled_from(["gauss", "few", "line", "far"]))
def test_insertion_agrees_with_every_pair(n, seed, kind):
    r = np.random.default_rng(seed)
    x, y = r.standard_normal(n), r.standard_normal(n)
    if kind == "few":  # many on common lines and circles
        x, y = np.unique(r.integers(0, 12, (n, 2)), axis=0).astype(float).T
    if kind == "line":
        x = np.arange(n) * 1.0
        y = 2 * x
    if kind == "far":
        x[0], y[1] = 1e5, -3e6
    assert _every_pair(x, y) == _edges(x, y)


@pytest.mark.parametrize(("n", "kinds"), [(625, "grid far line parabola close whole"), (1200, "far")])
def test_large_sets_agree_with_every_pair(n, kinds):
    k, r = np.arange(n), np.random.default_rng(n)
    sets = {
        "grid": (k % 25, k // 25), "far": (np.append(k % 25, -10_000), np.append(k // 25, -20_000)), "line": (k, 3 * k), "parabola": (k, k * k),
        "close": (np.append(r.uniform(0, 0.01, n - 10), r.standard_normal(10) * 5e3), np.append(r.uniform(0, 0.01, n - 10), r.standard_normal(10) * 5e3)),
        "whole": tuple(np.unique(r.integers(-40, 40, (n, 2)), axis=0).T),
    }
    for name in kinds.split():
        x, y = sets[name]
        assert _every_pair(np.asarray(x, float), np.asarray(y, float)) == _edges(x, y), name


def test_rounded_coordinates_and_circles():
    """What is co-circular but for the rounding of decimals counts as such; the answer is that of the whole numbers."""
    r = np.random.default_rng(3)
    for digits in (1, 2):
        whole = np.unique(np.round(r.standard_normal((700, 2)) * 10**digits), axis=0)
        assert _edges(*(whole / 10**digits).T) == _edges(*whole.T)
    turn = np.arange(900) * 2 * np.pi / 900
    assert _edges(np.cos(turn), np.sin(turn)) == sorted([(i, i + 1) for i in range(899)] + [(0, 899)])
    assert _edges([1e300, -1e300, 1e-300, 0, 5], [0, 1e300, 1e-300, -1e300, 1e-310])


def test_no_limit_to_a_group():
    r = np.random.default_rng(8)
    t = Triangulation(r.standard_normal(8000), r.standard_normal(8000))
    assert 8000 - len(t.edges()) + len(t.triangles()) == 1


def test_euler(spark):
    r = np.random.default_rng(4)
    rows = [(g, i, float(a), float(b)) for g in range(3) for i, (a, b) in enumerate(r.standard_normal((25, 2)))]
    e, t = delaunay_edges(_points(spark, rows)).groupBy("g").count(), delaunay_triangles(_points(spark, rows)).groupBy("g").count()
    edges, triangles = ({x["g"]: x["count"] for x in df.collect()} for df in (e, t))
    for g in range(3):  # n - e + t = 1
        assert 25 - edges[g] + triangles[g] == 1
    assert place_labels(_points(spark, rows)).count() == 75


def test_points_of_a_large_group_are_labelled(spark):
    r = np.random.default_rng(5)
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform(0, 0.01, (690, 2)))] + [(0, 700, 5e3, 5e3)] + [(0, 701 + i, float(i), -1.0) for i in range(9)]
    assert len(_labels(spark, rows)) == 700


def test_null_is_a_group_and_infinity_no_place(spark):
    rows = [(None, 1, 0.0, 0.0), (None, 2, 1.0, 0.0), (None, 3, 0.0, 2.0), (7, 4, 0.0, 0.0), (7, None, 5.0, 5.0), (7, 6, math.inf, 0.0), (7, 7, 1.0, -math.inf)]
    df = _points(spark, rows)
    assert sorted(_labels(spark, rows)) == [1, 2, 3, 4]
    assert sorted((r.g, r.i, r.j) for r in delaunay_edges(df).collect()) == [(None, 1, 2), (None, 1, 3), (None, 2, 3)]
    assert [tuple(r) for r in delaunay_triangles(df).collect()] == [(None, 1, 2, 3)]
    assert {r.g for r in neighbours(df).collect()} == {None}
    clusters = _points(spark, [(None if i % 2 else 1, i, math.inf if i == 9 else float(i * i % 7), float(i)) for i in range(12)])
    assert place_labels(clusters).count() == 11
    assert {r.g: r.raw_xmax for r in map_spec(df.where("x < 100"), "x", "y", by=["g"]).collect()} == {None: 1.0, 7: 5.0}
    assert map_spec(df.where("id = 4"), "x", "y").count() == 0 and map_spec(df, "x", "y").count() == 1


def test_groups_of_several_keys_and_text_ids(spark):
    rows = [("a", None, f"p{i}", float(i), float(i * i)) for i in range(4)] + [("a", 1, "q", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, m int, name string, LON double, LAT double")
    got = place_labels(df, id="name", x="LON", y="LAT", by=["k", "m"])
    assert got.columns[:3] == ["k", "m", "id"] and got.count() == 5
    assert place_labels(df, id="name", x="LON", y="LAT", by=[]).count() == 5


def test_empty(spark):
    assert place_labels(_points(spark, [])).count() == 0
    with pytest.raises(Exception):  # noqa: B017  an unknown column
        place_labels(_points(spark, []), x="nothing").count()
