"""Operators against values worked out elsewhere on small tables, and ways of scoring against each other."""

import math

import pytest
from pyspark.sql import functions as F

from coppice.operators import diversity, grow, sampling, scoring

# Twelve rows of three numbers, two codes and a class.
TWELVE = [
    (0, 1.0, 41.0, 2.0, "A", "C", 0),
    (1, 3.0, 37.0, 4.0, "A", "C", 0),
    (2, 5.0, 31.0, 6.0, "A", "C", 0),
    (3, 7.0, 23.0, 8.0, "A", "D", 0),
    (4, 11.0, 21.0, 10.0, "A", "D", 0),
    (5, 13.0, 19.0, 12.0, "A", "D", 0),
    (6, 17.0, 17.0, 14.0, "B", "D", 0),
    (7, 19.0, 13.0, 16.0, "B", "D", 0),
    (8, 21.0, 11.0, 18.0, "B", "D", 1),
    (9, 23.0, 7.0, 20.0, "B", "C", 1),
    (10, 31.0, 5.0, 22.0, "B", "C", 1),
    (11, 37.0, 3.0, 24.0, "B", "C", 1),
]
NAMES = ["x", "y", "z", "first", "second"]
# Neighbours of row 5 and how far they are.
OPEN_L1 = [4, 3, 6, 7, 8, 2, 1], [6, 14, 18.71862346, 26.71862346, 32.71862346, 36.71862346, 46.71862346]
OPEN_L2 = [4, 3, 6, 7, 8, 2, 9], [3.464101615, 8.246211251, 11.78511302, 14.24390708, 16.69996663, 18.94436298, 23.19003602]
CLOSED_L1 = [4, 3, 6, 7, 2, 1, 0], [6, 14, 18.71862346, 26.71862346, 36.71862346, 46.71862346, 54.71862346]
CLOSED_L2 = [4, 3, 6, 7, 2, 1, 0], [3.464101615, 8.246211251, 11.78511302, 14.24390708, 18.94436298, 24.55379581, 29.03254878]


@pytest.fixture(scope="module")
def twelve(spark):
    return spark.createDataFrame(TWELVE, "id long, x double, y double, z double, first string, second string, label int")


def test_median_deviation(twelve):
    assert sampling.median_of_stdev(twelve, ["x", "y", "z"]).first()[0] == pytest.approx(10.71862346, abs=1e-7)


@pytest.mark.parametrize("distance, within, want", [(sampling.l1, None, OPEN_L1), (sampling.l2, None, OPEN_L2), (sampling.l1, "label", CLOSED_L1), (sampling.l2, "label", CLOSED_L2)])
def test_neighbours_of_the_sixth_row(twelve, distance, within, want):
    penalty = sampling.median_of_stdev(twelve, ["x", "y", "z"]).first()[0]
    found = sampling.all_neighbours(twelve, "id", NAMES, 7, distance, ("first", "second"), penalty, within)
    got = found.where("id = 5").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == want[0]
    assert [r["distance"] for r in got] == pytest.approx(want[1], abs=1e-6)


def test_made_rows_of_the_twelve(twelve):
    counts = twelve.groupBy("label").agg(F.count("*").alias("n"))
    (few,) = sampling.smote_deficits(counts, {1: 0.5}).collect()
    assert (few["n"], few["wanted"], few["missing"]) == (4, 8, 4)  # 16 rows, 8 of each class
    made = sampling.smote_classes(twelve, "id", NAMES, {1: 4}, 3, "l1", ["first", "second"], False, 1).collect()
    low, high = {c: min(r[i + 1] for r in TWELVE) for i, c in enumerate("xyz")}, {c: max(r[i + 1] for r in TWELVE) for i, c in enumerate("xyz")}
    assert len(made) == 4 and all(r["label"] == 1 and r["first"] in "AB" and r["second"] in "CD" for r in made)
    assert all(low[c] <= r[c] <= high[c] for r in made for c in "xyz")


# The leaves of ten rows in five trees, and the proximities of different rows that share one.
LEAVES = [
    [12, 3, 10, 2, 8],
    [11, 10, 30, 36, 30],
    [20, 10, 30, 36, 29],
    [2, 2, 3, 2, 4],
    [18, 3, 8, 12, 20],
    [20, 9, 29, 30, 29],
    [20, 8, 30, 30, 28],
    [5, 7, 29, 7, 27],
    [16, 3, 10, 10, 18],
    [20, 10, 30, 36, 30],
]
SHARED = {(6, 9): 0.4, (5, 9): 0.2, (5, 7): 0.2, (5, 6): 0.4, (4, 8): 0.2, (2, 9): 0.8, (2, 6): 0.4, (2, 5): 0.4, (1, 9): 0.8, (1, 6): 0.2, (1, 2): 0.6, (0, 8): 0.4, (0, 4): 0.2, (0, 3): 0.2}


def test_proximities_of_ten_rows(spark):
    votes = spark.createDataFrame([(i, t, leaf) for i, own in enumerate(LEAVES) for t, leaf in enumerate(own)], "row_id long, tree int, leaf int")
    name = {r["pattern"]: r["row_id"] for r in diversity.row_patterns(votes, 5).collect()}
    assert len(name) == 10
    got = {tuple(sorted((name[r["i"]], name[r["j"]]))): r["prox"] for r in diversity.proximity(diversity.leaf_patterns(votes, 5), 5).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == SHARED | {(i, i): 1.0 for i in range(10)}
    near = diversity.nearest(diversity.proximity(diversity.leaf_patterns(votes, 5), 5), 1).collect()
    assert all(SHARED.get(tuple(sorted((name[r["i"]], name[r["j"]]))), 1.0) == pytest.approx(r["prox"]) for r in near)


@pytest.mark.parametrize("weights", [None, [0.5, 2.25, 1.0]])
def test_tallies_equal_those_of_votes(spark, monkeypatch, weights):
    rows = spark.range(900).select("id", (F.col("id") * 37 % 101).cast("double").alias("x y"), F.when(F.col("id") % 7 > 0, F.col("id") % 4).cast("int").alias("code"))
    rows = rows.withColumn("label", ((F.col("x y") / 30).cast("int") + F.coalesce("code", F.lit(1))) % 3)
    bags = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tree"), F.lit(1).cast("long").alias("weight")).where("(id + tree) % 3 > 0")
    trees = grow.grow(rows, "id", ["x y", "code"], 3, bags, 3, discrete={"code": 4})
    weight = None if weights is None else F.element_at(F.array(*map(F.lit, weights)), F.col("tree") + 1)
    rounded = lambda df: sorted((r["id"], *[round(r[c], 9) for c in ("v0", "v1", "v2", "p0", "p1", "p2")]) for r in df.collect())
    want = None
    for nodes in (1 << 20, 0):  # as expressions, as arrays
        monkeypatch.setattr(scoring, "FEW_NODES", nodes)
        cast = scoring.votes(rows, ["id"], trees, 3)
        by_votes, at_once = rounded(scoring.tally(cast, ["id"], 3, weight)), rounded(scoring.tallies(rows, ["id"], trees, 3, weights))
        assert by_votes == at_once and len(at_once) == 900
        assert want in (None, at_once)
        want = at_once
    assert all(math.isclose(sum(r[4:]), 1.0, abs_tol=1e-6) for r in want)
