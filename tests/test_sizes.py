"""What a step holds or compares must not grow faster than its input; results by plain Python."""

import numpy as np
from pyspark.sql import functions as F

from coppice.functions.scalars import MODULUS, draw, draw_for_filter, drawn
from coppice.operators import diversity, regions, sampling


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_draw_meets_the_rows_of_a_cell_alone(spark):
    n = 40000
    rows = spark.range(n).select("id", (F.col("id") % 7).alias("w"))
    got = sampling.weighted_draw(rows, "id", "w", n, seed=5)
    total = sum(i % 7 for i in range(n))
    assert f"/ {total // (n // 8) + 1}" in plan(got).replace(".0", "")  # cells of about 8 draws, not of a part in 1024
    upto = np.cumsum(np.arange(n) % 7)
    u = (drawn(np.arange(n), 5) * MODULUS + drawn(np.arange(n), 6)) % total
    want = np.searchsorted(upto, u, "right").tolist()
    assert [r["id"] for r in got.orderBy("draw").collect()] == want


def test_places_filter_by_no_draw(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)] + [(None, 1)], "id long, label int")
    placed = sampling.shuffled_places(rows, "id", "label", 3)
    assert not [line for line in plan(placed).splitlines() if "Filter" in line and str(MODULUS) in line]
    assert placed.count() == 50  # a row without a key has no place


def test_smoothing_pairs_places_not_nodes(spark):
    nodes = spark.createDataFrame([(t, 0, t * 1000 + i, float(i % 3), float(i % 2 * 5), None if i % 11 == 0 else float(i)) for t in (1, 2) for i in range(60)] + [(1, 0, 9, None, 1.0, 2.0), (3, 0, 1, 0.0, 0.0, None)], "timestep int, mesh int, node long, x double, y double, value double")
    smoothed = regions.smoothed(nodes, "value", 2.0, ("x", "y"))
    rows = nodes.collect()
    want = {}
    for a in rows:
        if a["x"] is not None:
            near = [b["value"] for b in rows if b["x"] is not None and b["timestep"] == a["timestep"] and (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= 4 and b["value"] is not None]
            want[a["timestep"], a["node"]] = sum(near) / len(near) if near else None
    got = {(r["timestep"], r["node"]): r["value"] for r in smoothed.collect()}
    assert got == want
    assert "Broadcast" not in smoothed._jdf.queryExecution().executedPlan().toString()
    both = regions.near_pairs(nodes, nodes, ["x", "y"], 2.0, ["timestep"])
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_queries_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 40)
    points = [(i, i % 2, float(i * 37 % 11), float(i * 53 % 7)) for i in range(300)]
    rows = spark.createDataFrame([*points, (300, 0, None, 1.0)], "id long, label int, a double, b double")
    for distance, label in ((sampling.l1, None), (sampling.l2, "label")):
        found = sampling.neighbours(rows.where("id % 50 = 0 and id < 300"), rows, "id", ["a", "b"], 3, distance, label)
        got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in found.collect()}
        for q in points[::50]:
            gap = lambda p: abs(p[2] - q[2]) + abs(p[3] - q[3]) if distance is sampling.l1 else round(((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5, 9)  # noqa: B023, E731
            best = sorted((gap(p), p[0]) for p in points if p[0] != q[0] and (label is None or p[1] == q[1]))[:3]
            assert [got[q[0], i + 1] for i in range(3)] == [(p, d) for d, p in best]
        assert "_bound" in plan(found)  # only pairs within a bound are ranked
    two = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 1.0, 0.0), (3, 0, None, 0.0)], "id long, label int, a double, b double")
    got = sampling.neighbours(two.where("id = 1"), two, "id", ["a", "b"], 3).orderBy("rank").collect()
    assert [(r["neighbour"], r["distance"]) for r in got] == [(2, 1.0), (3, None)]


def test_differences_in_one_shuffle_of_points(spark):
    a = spark.createDataFrame([(1, 0, 5, [1, 2, 3, 3]), (1, 0, 6, [4])], "timestep int, mesh int, label long, members array<long>")
    b = spark.createDataFrame([(1, 0, 5, [2, 3, 9]), (2, 0, 6, [4])], "timestep int, mesh int, label long, members array<long>")
    found = regions.differences(a, b)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1  # no counts before the points are dealt
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("a", 1, 0, 5, 1), ("a", 1, 0, 6, 4), ("b", 1, 0, 5, 9), ("b", 2, 0, 6, 4)]


def test_outliers_look_up_patterns_and_send_heavy_ones(spark, monkeypatch):
    leaves = [(i, i % 2 if i else None, t, i * i // (t + 2) % 7 if i % 5 else 0) for i in range(60) for t in range(2)]
    votes = spark.createDataFrame(leaves, "row_id long, label int, tree int, leaf int")
    plain = {}
    for i, label, t, leaf in leaves:
        plain.setdefault((i, label), []).append(leaf)
    plain = {k: v for k, v in plain.items() if k[1] is not None}
    prox = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 2
    raw = {k: 1 / (sum(prox(v, w) ** 2 for m, w in plain.items() if m[1] == k[1]) - 1) for k, v in plain.items()}
    for deviation in ("absolute", "standard"):
        want = {}
        for label in (0, 1):
            own = sorted(r for k, r in raw.items() if k[1] == label)
            mid = own[(len(own) - 1) // 2]
            off = sorted(abs(r - mid) for r in own)
            dev = off[(len(off) - 1) // 2] if deviation == "absolute" else np.std(own, ddof=1)
            want |= {k[0]: (r - mid) / dev for k, r in raw.items() if k[1] == label}
        for heavy in (3, 1 << 18):
            monkeypatch.setattr(diversity, "HEAVY_ROWS", heavy)
            got = {r["row_id"]: r["score"] for r in diversity.outliers(votes, 2, deviation=deviation).collect()}
            assert got.keys() == want.keys()
            np.testing.assert_allclose([got[k] for k in want], [want[k] for k in want], atol=1e-9)


def test_draws_in_conditions_are_computed_once(spark):
    keys = [0, 1, 5, (1 << 40) + 3, -7, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    both = rows.select(draw(F.col("k"), 9).alias("a"), draw_for_filter(F.col("k"), 9).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(r["b"] is None for r in both) == 1
    kept = rows.where(draw_for_filter(F.col("k"), 9) % 5 == 0)
    assert str(MODULUS) not in plan(kept)  # no formula in the filter
    assert kept.count() == rows.where(draw(F.col("k"), 9) % 5 == 0).count()
