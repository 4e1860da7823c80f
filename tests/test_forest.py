import glob
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from coppice import queries as Q
from coppice.functions import scalars as S
from coppice.operators import forest, grow, sampling, scoring, split
from coppice.sources import models

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_information_measures(spark):
    lit = F.lit
    assert one(spark, split.entropy([lit(25)] * 4)) == pytest.approx(2.0)
    assert one(spark, split.entropy([lit(200), lit(100), lit(50), lit(25), lit(25)])) == pytest.approx(1.875)
    assert one(spark, split.information_gain([[lit(100)] * 4] * 4)) == pytest.approx(0.0)


def test_c45_on_ten_values(spark):
    rows = spark.createDataFrame([(i, c, 0, float(i)) for i, c in enumerate([0, 0, 0, 0, 1, 0, 1, 1, 1, 1])], "row int, label int, attribute int, value double")
    cuts = split.candidates(split.histogram(rows, [], 2), [], 2, fixed=1, dynamic=False)
    best = split.best_cuts(cuts, [], 2, "c45").first()
    gain = 1 - 0.6 * (-(1 / 6) * math.log2(1 / 6) - (5 / 6) * math.log2(5 / 6))
    info = -0.4 * math.log2(0.4) - 0.6 * math.log2(0.6)
    assert best["threshold"] == 3.5
    assert best["score"] == pytest.approx((gain - math.log2(9) / 10) / info)


def test_lower_median_and_smallest_mode(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (1,)], "x int")
    assert df.agg(S.lower_median("x")).first()[0] == 2
    assert df.agg(S.smallest_mode("x")).first()[0] == 1


def test_boost_weights_of_seven_rows(spark):
    rows = spark.createDataFrame([(i, 1.0, i < 3) for i in range(7)], "row int, w double, wrong boolean")
    out = {r["row"]: r["next_weight"] for r in sampling.boost_round(rows, "w", F.col("wrong")).collect()}
    assert out[0] == pytest.approx(1 / 6) and out[5] == pytest.approx(1 / 8)


def test_stop_block_and_folds(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(270)], "id long, label int")
    counts = sampling.stratified_folds(rows, "id", "label", 3).groupBy("fold", "label").count().collect()
    assert {r["count"] for r in counts} == {30}


def test_grown_tree_separates_and_round_trips(spark):
    rows = spark.range(400).select("id", F.when((F.col("id") < 100) | (F.col("id") >= 300), 1).otherwise(0).alias("label"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    trees = grow.grow(rows, "id", ["a", "b"], 2, depth=4)
    v = scoring.votes(rows, ["id", "label"], trees, 2)
    assert v.where("pred != label").count() == 0
    again = models.ensemble_of(models.ensemble_text(models.Ensemble(tuple(trees), 2, ("a", "b"))), ["a", "b"])
    assert scoring.votes(rows, ["id", "label"], list(again.trees), 2).where("pred != label").count() == 0
    assert "digraph" in grow.to_dot(trees[0])


def test_discrete_growth_empty_branches_and_nulls(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).cast("int").alias("kind"), F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 3 == 1, 1).otherwise(0).alias("label"))
    tree = grow.grow(rows, "id", ["x", "kind"], 2, discrete={"kind": 4})[0]
    assert tree.attribute == "kind" and tree.threshold is None and [c.label for c in tree.children] == [0, 1, 0, 0]
    # nobody has the fourth value: its branch says the parent's class and errs in nothing
    assert not tree.children[3].seen and tree.children[3].counts == (133, 67) and grow.errors(tree) == 0
    for walked in (scoring.votes, scoring.walked):
        assert walked(rows, ["id", "label"], [tree], 2).where("pred != label").count() == 0
    # a null is on no side of a cut: those with values decide it
    holes = rows.withColumn("label", F.when(F.col("id") < 100, 0).otherwise(1))
    cut = grow.grow(holes, "id", ["x"], 2, depth=1, criterion="infogain")[0]
    assert cut.attribute == "x" and cut.threshold == 100.0
    none = grow.grow(rows, "id", ["x", "kind"], 2, discrete={"kind": 4}, masks={0: [0]}, depth=1)[0]
    assert none.attribute in (None, "x")


def test_fit_test_and_cross_validate(spark):
    rows = spark.range(240).select("id", (F.col("id") % 40).cast("double").alias("a"), F.when(F.col("id") % 7 != 0, (F.col("id") % 11).cast("double")).alias("b"), F.when(F.col("id") % 40 < 13, 1).otherwise(0).alias("label"))
    model = forest.fit(rows, "id", ["a", "b"], 2, forest.Options(trees=2, depth=2, seed=4))
    out = {(r["scope"], r["class"]): r for r in forest.tested(model, rows, "id")["measures"].collect()}
    assert out["overall", None]["accuracy"] == 1 and out["class", 1]["n"] == 78 and out["mean", None]["accuracy"] == 1
    folded = forest.cross_validated(rows, "id", ["a", "b"], 2, 2, forest.Options(trees=1, bagging=None, depth=2))
    assert folded.count() == 240 and folded.where("pred != label").count() <= 12
    for wrong in ({"split": "x"}, {"bagging": 0}, {"boosting": True, "ivoting": True}, {"balanced": True}, {"minority": {0: 1.0}}, {"forest": 1, "totally_random": True}):
        with pytest.raises(ValueError):
            forest.Options(**wrong)
    assert forest.Options(trees=3).described() == "trees: 3\n"


def test_tree_text_of_either_style():
    text = """#comment
NumClasses           2
NumTrees             2
AttributeTypes: CONTINUOUS DISCRETE
MissingAttributeValues: 1.5,b
Tree 1
SPLIT CONTINUOUS ATT# 0 < 2.50000
LEAF Class 1 Proportions 1 4
SPLIT CONTINUOUS ATT# 0 >= 2.50000
SPLIT DISCRETE ATT# 1 VAL# 1 / 2
LEAF 0
SPLIT DISCRETE ATT# 1 VAL# 2 / 2
LEAF 1
Tree 2
LEAF 0
"""
    e = models.ensemble_of(text, ["x", "k"])
    assert (e.classes, e.discrete, e.imputed, len(e.trees)) == (2, {"k": 2}, ("1.5", "b"), 2)
    assert e.trees[0].threshold == 2.5 and e.trees[0].children[0].counts == (1, 4)
    assert scoring.leaf_probabilities(e.trees[0].children[1].children[1], 2) == [0.0, 1.0]
    assert models.ensemble_of(models.ensemble_text(e), ["x", "k"]) == e
    for broken in (text.replace("LEAF Class 1 Proportions 1 4\n", ""), text.replace("NumTrees             2", "NumTrees             3"), text + "SPLIT\n"):
        with pytest.raises(ValueError):
            models.ensemble_of(broken, ["x", "k"])
    assert models.concatenated([e, e]).trees == e.trees * 2


def test_all_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sampling, "NEAR", 24)
    rng = random.Random(3)
    data = [(i, rng.choice([rng.random() * 100, 50.0]), float(rng.randrange(20)), rng.randrange(3), i % 2) for i in range(500)]
    data += [(500 + i, 50.0, 7.0, 1, i % 2) for i in range(90)]  # one point of many rows
    rows = spark.createDataFrame(data, "id long, x double, y double, k int, label int").unionByName(spark.createDataFrame([(999, None, 1.0, 1, 0)], "id long, x double, y double, k int, label int"))
    for within, distance, names in ((None, sampling.l2, ["x", "y", "k"]), ("label", sampling.l1, ["x", "y", "k"]), (None, sampling.l1, ["y"])):
        got = {}
        for r in sampling.all_neighbours(rows, "id", names, 3, distance, ("k",), 5.0, within).collect():
            got.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["neighbour"])
        there = data if "x" in names else [*data, (999, None, 1.0, 1, 0)]  # a row without a used attribute takes no part
        assert sorted(got) == [r[0] for r in there]
        at = {"x": 1, "y": 2}
        for a in data[::17]:
            gaps = lambda b: [abs(a[at[c]] - b[at[c]]) if c in at else 5.0 * (a[3] != b[3]) for c in names]  # noqa: B023, E731
            far = lambda b: round(sum(gaps(b)) if distance is sampling.l1 else math.sqrt(sum(g * g for g in gaps(b))), 9)  # noqa: B023, E731
            near = sorted((far(b), b[0]) for b in there if b[0] != a[0] and (within is None or a[4] == b[4]))
            assert [got[a[0]][i] for i in (1, 2, 3)] == [(pytest.approx(x), n) for x, n in near[:3]]


@pytest.mark.parametrize("name", ["grow_tree", "cv_train", "partition_train", "train_test_error", "bag_counts", "majority_bag", "seg_report", "measures", "remoteness", "noised_importance", "radius_smoothing", "best_split_c45", "impute_median_mode", "vote_memv", "oob_error_curve", "auroc_ovr", "diversity_kappa", "outlier_score", "region_overlap", "weighted_draw", "knn_l1"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(x[0] for x in con.execute(Q.ORACLE[name]).description) == columns
    want = con.execute(f"select {', '.join(columns)} from ({Q.ORACLE[name]})").fetchall()
    show = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in row) for row in rows), key=str)
    assert show(tuple(r) for r in got.select(*columns).collect()) == show(want)
