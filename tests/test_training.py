import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions import scalars as S
from coppice.operators import diversity, forest, grow, sampling, scoring, train
from coppice.operators.votes import VoteStore
from coppice.sources import models


def test_bags_follow_their_law_in_any_order(spark):
    n = 20000
    rows = sampling.numbered(spark.range(n).select((F.col("id") * 3).alias("k")), "k")
    for drawn, percent in ((sampling.bag(rows, "k", n, 2), 100), (sampling.bag(rows, "k", n, 2, 40), 40), (sampling.drawn_bag(rows, "k", n, 2), 100)):
        for r in drawn.groupBy("tree").agg(F.count("*").alias("held"), F.sum("weight").alias("draws"), F.count_if(F.col("weight") == 2).alias("twice")).collect():
            mean = percent / 100
            assert r["draws"] == n * percent // 100
            assert abs(r["held"] / n - (1 - math.exp(-mean))) < 0.02 and abs(r["twice"] / n - math.exp(-mean) * mean**2 / 2) < 0.02
    # rows in any order and any partitions get the same counts: those of the ranges by themselves
    mixed = {r["k"]: r["weight"] for r in sampling.bag(rows.repartition(5), "k", n, 1, 100, 7).collect()}
    alone = [int(x) for r in range(-(-n >> sampling.BAG_BITS)) for x in sampling.range_counts(n, n, 7, 0, r)]
    assert mixed == {3 * i: x for i, x in enumerate(alone) if x} and sum(alone) == n


def test_range_counts_follow_the_multinomial_law():
    n = 3 * 4096 + 100
    sums = np.zeros(4)
    for seed in range(300):
        sums += [sampling.range_counts(n, n, seed, 1, r).sum() for r in range(4)]
    expected = 300 * np.array([4096, 4096, 4096, 100])
    assert ((sums - expected) ** 2 / expected).sum() < 16.3  # 0.999 of 3 degrees
    big = 5 * (1 << 31) + 17
    last = (big >> 12) - 1  # rows far beyond 2 ** 31
    late = sampling.range_counts(big, big, 3, 0, last)
    assert len(late) == 4096 and abs(late.sum() - 4096) < 6 * 64
    assert (late != sampling.range_counts(big, big, 3, 0, last % (1 << 19))).any()


def test_draws_agree_and_have_no_short_period(spark):
    keys = [0, 1, 5, S.MODULUS - 1, S.MODULUS, S.MODULUS + 5, 10**12, 2**61 - 3, 2**62 + 12345, 2**63 - 1]
    got = [r["x"] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(S.draw(F.col("k"), 3).alias("x")).collect()]
    assert got == S.drawn(np.array(keys), 3).tolist()
    assert got == list(duckdb.connect().execute("select " + ", ".join(S.draw_sql(str(k), 3) for k in keys)).fetchone())
    key = np.arange(100000)
    for step in (S.MODULUS, 2 * S.MODULUS, 1 << 40):
        assert (S.drawn(key) == S.drawn(key + step)).mean() < 0.01
    assert abs(S.drawn(key + (1 << 50)).mean() / S.MODULUS - 0.5) < 0.01


def told(tree):
    return [(n.attribute, n.threshold, n.label, n.counts, len(n.children), n.seen) for n in scoring.nodes_of(tree)]


@pytest.fixture(scope="module")
def mixed_rows(spark):
    """Numbers, codes, nulls and codes that aren't declared."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b, c = rng.choice([None, *range(30)]), rng.randrange(12) + rng.random(), rng.choice([0, 1, 2, 3, 5, None])
        label = (0 if b < 4 else 1 if (a or 0) > 15 else 2) if rng.random() < 0.8 else rng.randrange(3)
        rows.append((i, None if a is None else float(a), b, None if c is None else float(c), label))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int").cache()


@pytest.mark.parametrize("options", [{}, {"criterion": "gainratio"}, {"criterion": "hellinger", "attributes_a_node": 2}, {"cuts": "extremely_random", "attributes_a_node": 2}, {"cuts": "totally_random", "masks": {0: [0, 2], 1: [1, 2]}}, {"subsample": 60, "zero_gain": True, "collapse": False}])
def test_tasks_grow_the_trees_that_levels_grow(spark, mixed_rows, options):
    kinds = {"discrete": {"c": 4}, "trees": 2, "seed": 5, "depth": 3} | options
    levels = grow.grow(mixed_rows, "id", ["a", "b", "c"], 3, small=0, **kinds)
    both = grow.grow(mixed_rows, "id", ["a", "b", "c"], 3, small=150, **kinds)
    tasks = grow.grow(mixed_rows, "id", ["a", "b", "c"], 3, **kinds)
    assert [told(t) for t in levels] == [told(t) for t in both] == [told(t) for t in tasks]
    assert any(t.children for t in tasks)


def plain_growth(rows, attributes, classes):
    """Growth by information gain of numbers without nulls, to the end, in plain Python."""
    count = lambda part: [sum(r[-1] == k for r in part) for k in range(classes)]
    entropy = lambda c: -sum(x / sum(c) * math.log2(x / sum(c)) for x in c if x)

    def grown(part):
        c = count(part)
        n = len(part)
        least = min(25, max(2, int(n * 0.1 / classes)))
        leaf = (None, None, c.index(max(c)), tuple(c), [])
        if max(c) == n or n < 2 * least:
            return leaf
        best = None
        for a in range(attributes):
            values = sorted({r[a] for r in part})
            for low, high in zip(values, values[1:]):
                left, right = [r for r in part if r[a] <= low], [r for r in part if r[a] > low]
                if min(len(left), len(right)) >= least:
                    gain = entropy(c) - len(left) / n * entropy(count(left)) - len(right) / n * entropy(count(right))
                    if best is None or round(gain, 9) > round(best[0], 9):
                        best = (gain, a, (low + high) / 2)
        if best is None or best[0] <= 1e-9:
            return leaf
        kids = [grown([r for r in part if r[best[1]] < best[2]]), grown([r for r in part if r[best[1]] >= best[2]])]
        return leaf if all(k[0] is None and k[2] == leaf[2] for k in kids) else (best[1], best[2], *leaf[2:4], kids)

    return grown(rows)


def test_growth_without_depth_equals_plain_python(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(40), rng.random(), rng.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame([(i, float(a), b, k) for i, (a, b, k) in enumerate(rows)], "id long, a double, b double, label int")
    tree = grow.grow(df, "id", ["a", "b"], 3, criterion="infogain", collapse=False)[0]

    def same(node, want):
        attribute = None if want[0] is None else "ab"[want[0]]
        return (node.attribute, node.label, node.counts) == (attribute, *want[2:4]) and (attribute is None or math.isclose(node.threshold, want[1])) and all(same(c, k) for c, k in zip(node.children, want[4], strict=True))

    assert scoring.levels(tree) > 8 and same(tree, plain_growth(rows, 2, 3))


def test_deep_trees(spark):
    """A chain of 3000 branches is counted, written, read, drawn and scored."""
    node = scoring.Node(6001, label=1, counts=(0, 1))
    for i in reversed(range(3000)):
        node = scoring.Node(2 * i + 1, "x", float(i), (scoring.Node(2 * i + 2, label=i % 2, counts=(1 - i % 2, i % 2)), node), 0, (3, 3))
    assert scoring.node_count(node) == 6001 and scoring.levels(node) == 3001
    text = models.ensemble_text(models.Ensemble((node,), 2, ("x",)))
    again = models.ensemble_of(text, ["x"]).trees[0]
    assert scoring.node_count(again) == 6001 and models.ensemble_text(models.Ensemble((again,), 2, ("x",))) == text
    assert grow.errors(node) == 0 and grow.to_dot(node).count("->") == 6000
    rows = spark.range(10).select("id", (F.col("id") * 101 - 0.5).alias("x"))
    got = {r["id"]: r["pred"] for r in scoring.votes(rows, ["id"], [node], 2).collect()}
    assert got == {i: (i * 101) % 2 for i in range(10)}
    back = models.trees_of(models.node_table(spark, [node]))[0]
    assert [x[:4] for x in told(back)] == [x[:4] for x in told(node)]


def test_vote_store_equals_plain_counts(spark):
    rng = random.Random(2)
    votes = [(row, row % 3, tree, rng.randrange(3)) for row in range(60) for tree in range(7) if rng.random() < 0.6]
    store = VoteStore(spark, "row", 3)
    curves = []
    for first, end in ((0, 2), (2, 3), (3, 7)):
        block = [v for v in votes if first <= v[2] < end]
        curves += store.append(spark.createDataFrame(block, "row long, label int, tree int, pred int")).collect()
    counts, want = {}, {}
    for tree in range(7):
        wrong, right, n = 0, 0, 0
        for row, label, _, pred in (v for v in votes if v[2] == tree):
            c = counts.setdefault(row, [0, 0, 0])
            c[pred] += 1
            wrong, right, n = wrong + (c.index(max(c)) != label), right + (pred == label), n + 1
        want[tree] = (n, pytest.approx(wrong / n), pytest.approx(right / n))
    assert {r["tree"]: (r["rows"], r["error"], r["accuracy"]) for r in curves} == want
    assert sorted(tuple(r) for r in store.votes().collect()) == sorted(votes)
    assert {r["row"]: [r["v0"], r["v1"], r["v2"]] for r in store.counts().collect()} == counts


def test_out_of_bag_errors_of_seven_rows(spark):
    """Three trees, each with its own bag; the errors and the final votes of the cumulative out-of-bag vote, by hand."""
    bags = [{0, 2, 4}, {1, 3, 5}, {0, 1, 2, 3, 4, 5}]
    label = [0, 1, 2, 0, 1, 2, 0]
    pred = [[0, 1, 2, 0, 1, 0, 0], [0, 0, 2, 0, 2, 2, 0], [0, 1, 2, 0, 1, 2, 0]]
    store, errors = VoteStore(spark, "row", 3), []
    for t in range(3):
        block = [(i, label[i], t, pred[t][i]) for i in range(7) if i not in bags[t]]
        errors.append(store.append(spark.createDataFrame(block, "row long, label int, tree int, pred int")).first()["error"])
    assert errors == [0.25, 0.25, 0.0]


def test_noised_importance_equals_brute_force(spark):
    """Cumulative votes, tree by tree, of rows whose values are dealt anew among a tree's out-of-bag rows."""
    n = 60
    data = [(i, float(i % 12), float(i * 7 % 30), i % 3) for i in range(n)]
    rows = spark.createDataFrame(data, "id long, quantity double, tax double, label int")
    leaf = lambda i, k: scoring.Node(i, label=k, counts=tuple(int(j == k) for j in range(3)))
    trees = [scoring.Node(1, "quantity", 5.5, (leaf(2, 0), leaf(3, 1))), scoring.Node(1, "tax", 11.5, (leaf(2, 2), leaf(3, 0))), scoring.Node(1, "quantity", 3.5, (leaf(2, 0), scoring.Node(3, "tax", 20.5, (leaf(6, 1), leaf(7, 2)))))]
    bags = {(t, i) for t in range(3) for i in range(n) if (i * 5 + t) % 4}
    said = lambda t, q, x: [0 if q < 5.5 else 1, 2 if x < 11.5 else 0, 0 if q < 3.5 else 1 if x < 20.5 else 2][t]
    out = [[i for i in range(n) if (t, i) not in bags] for t in range(3)]

    def error(values):
        counts, wrong = {}, 0
        for t in range(3):
            wrong = 0
            for i in out[t]:
                c = counts.setdefault(i, [0, 0, 0])
                c[said(t, *values[t][i])] += 1
                wrong += c.index(max(c)) != data[i][3]
        return wrong / len(out[2])

    plain = [{i: data[i][1:3] for i in range(n)} for _ in range(3)]
    want = {}
    for a, name in enumerate(["quantity", "tax"]):
        dealt = [dict(p) for p in plain]
        for t in range(3):
            order = [sorted(out[t], key=lambda i, s=s: (int(S.drawn(np.array([i]), s)[0]), i)) for s in (51, 52)]
            for i, j in zip(*order, strict=True):
                dealt[t][i] = (data[j][1], data[i][2]) if a == 0 else (data[i][1], data[j][2])
        want[name] = (pytest.approx(error(plain)), pytest.approx(error(dealt)))
    got = train.noised_importance(rows, "id", ["quantity", "tax"], trees, 3, spark.createDataFrame(sorted(bags), "tree int, id long"), seed=51).collect()
    assert {r["attribute"]: (r["error"], r["noised_error"]) for r in got} == want


@pytest.fixture(scope="module")
def uneven(spark):
    """Two classes, one in eight rows of the smaller one."""
    return spark.range(320).select("id", (F.col("id") % 40).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"), (F.col("id") % 3).cast("double").alias("c"), F.when(F.col("id") % 40 < 5, 1).otherwise(0).alias("label")).cache()


@pytest.mark.parametrize("options", [{"balanced": True}, {"majority_bagging": True}, {"smote": "closed"}, {"smote": "open", "distance": "l1"}, {"smoteboost": "all"}, {"smoteboost": "subset"}, {"ivoting": True, "bite": 80}, {"majority_ivoting": True}, {"totally_random": True, "zero_gain": True}, {"subspaces": 70}, {"boosting": True}])
def test_each_option_trains(spark, uneven, options):
    share = {"minority": {1: 0.4}} if {"balanced", "majority_bagging", "smote", "smoteboost", "majority_ivoting"} & set(options) else {}
    model = forest.fit(uneven, "id", ["a", "b", "c"], 2, forest.Options(trees=2, seed=3, **options, **share), {"c": 3}, test=None if {"boosting", "smoteboost"} & set(options) else uneven)
    out = forest.tested(model, uneven, "id")["measures"].where("scope = 'overall'").first()
    assert len(model.trees) >= 1 and out["accuracy"] > 0.8
    if model.tests is not None:
        assert sorted(r["tree"] for r in model.tests.collect()) == [0, 1]
    if "ivoting" in options:
        assert model.cast.votes().where("tree = 1").count() > 0


def test_partitions_grow_as_by_themselves(spark, uneven):
    rows = uneven.withColumn("part", F.col("id") % 3).withColumn("a", F.when(F.col("id") % 11 != 0, F.col("a")))
    options = forest.Options(trees=2, bagging=None, split="infogain")
    found = forest.fit_partitions(rows, "id", ["a", "b"], 2, "part", options)
    assert sorted(found) == [0, 1, 2]
    own = forest.fit(rows.where("part = 1"), "id", ["a", "b"], 2, options)
    assert [told(t) for t in found[1].trees] == [told(t) for t in own.trees]
    bagged = forest.fit_partitions(rows, "id", ["a", "b"], 2, "part", forest.Options(trees=2))
    voted = scoring.combine(forest.partition_votes(bagged, uneven, ["id", "label"]), ["id", "label"], 2, "mmv")
    assert voted.count() == 320 and voted.where("pred = label").count() > 280
    with pytest.raises(ValueError):
        forest.fit_partitions(rows, "id", ["a", "b"], 2, "part", forest.Options(boosting=True))


def test_folds_impute_from_their_own_training_rows(spark, uneven):
    rows = uneven.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a")))
    out = forest.cross_validated(rows, "id", ["a", "b"], 2, 2, forest.Options(trees=1, bagging=None))
    assert out.count() == 320 and out.where("pred != label").count() < 60
    model = forest.fit(rows, "id", ["a", "b"], 2, forest.Options(trees=1))
    assert models.ensemble_of(models.ensemble_text(model.ensemble), ["a", "b"]).imputed == model.ensemble.imputed != ()


@pytest.mark.parametrize("options", [{}, {"cuts": "extremely_random", "attributes_a_node": 2}])
def test_folds_by_complement_grow_as_with_bags(spark, mixed_rows, options):
    dealt = sampling.stratified_folds(mixed_rows, "id", "label", 3, 4).cache()
    kinds = {"trees": 3, "discrete": {"c": 4}, "depth": 3} | options
    bags = [dealt.where(F.col("fold") != f).select(F.lit(f).alias("tree"), "id", F.lit(1).alias("weight")) for f in range(3)]
    want = grow.grow(mixed_rows, "id", ["a", "b", "c"], 3, bags[0].union(bags[1]).union(bags[2]), **kinds)
    for small in (0, 100, None):
        assert [told(t) for t in grow.grow(dealt, "id", ["a", "b", "c"], 3, folds="fold", small=small, **kinds)] == [told(t) for t in want]


def test_nearest_patterns_equal_brute_force(spark):
    """Fifty trees, each row a pattern of its own; families of patterns that share most leaves; one leaf that most have."""
    rng = random.Random(9)
    patterns = set()
    for family in range(12):
        base = [rng.randrange(40) for _ in range(50)]
        for _ in range(15):
            own = [x if rng.random() < 0.8 else rng.randrange(40) for x in base]
            own[0] = 1 if rng.random() < 0.9 else 2
            patterns.add("-".join(map(str, own)))
    patterns = sorted(patterns)
    df = spark.createDataFrame([(p, 1) for p in patterns], "pattern string, n long")
    got = {}
    for r in diversity.nearest_patterns(df, 50, 4).collect():
        got.setdefault(r["i"], {})[r["rank"]] = (r["j"], r["prox"])
    leaves = {p: p.split("-") for p in patterns}
    for p in patterns[::7]:
        near = sorted((-sum(a == b for a, b in zip(leaves[p], leaves[o], strict=True)), o) for o in patterns if o != p)
        assert [got[p][i] for i in (1, 2, 3, 4)] == [(o, pytest.approx(-n / 50)) for n, o in near[:4]]


def test_rows_that_are_alike_are_held_as_one(spark, monkeypatch):
    """Copies are one row with the sum of their weights; trees are those of the rows themselves."""
    rng = random.Random(4)
    few = [(float(rng.randrange(5)), rng.randrange(3), None if rng.random() < 0.1 else float(rng.randrange(4))) for _ in range(40)]
    data = [(i, *few[rng.randrange(40)]) for i in range(2000)]
    rows = spark.createDataFrame(data, "id long, a double, label int, b double")
    held = grow.held(rows, "id", ["a", "b"], None, 2)
    one, n = grow.alike(held, "id", ["a", "b"], 2)
    assert n == one.count() <= 40 and one.agg(F.sum(F.col("weights")[1])).first()[0] == 2000
    bags = sampling.bag(sampling.numbered(rows.select("id"), "id"), "id", 2000, 2)
    weighted = sampling.bag_weights(sampling.numbered(rows, "id"), 2000, 2)
    dealt = rows.withColumn("fold", (F.col("id") % 2).cast("int"))
    grown = lambda small: [grow.grow(rows, "id", ["a", "b"], 3, bags, 2, small=small), grow.grow(weighted, "id", ["a", "b"], 3, trees=2, small=small, weights="weights"), grow.grow(dealt, "id", ["a", "b"], 3, trees=2, small=small, folds="fold")]
    got = [grown(None), grown(0)]
    monkeypatch.setattr(grow, "ALIKE", 1 << 40)
    want = grown(None)
    assert want[0] == want[1] and got == [want, want]


def test_samples_of_nodes_are_those_of_all_rows(spark, mixed_rows):
    data = grow.held(mixed_rows, "id", ["a", "b", "c"], None, 2)
    growing = [grow.Growing(t) for t in range(2)]
    growing[0].divide(0, 0, 5.0, 2)
    growing[0].open = [1, 2]
    for t in growing:
        counts = {(r["tree"], r["node"]): r["count"] for r in grow.placed(data, "id", ["a", "b", "c"], growing).groupBy("tree", "node").count().collect()}
        for i in t.open:
            t.counts[i] = (counts.get((t.tree, i), 0), 0, 0)
    units = grow.placed(data, "id", ["a", "b", "c"], growing).withColumn("_unit", F.col("tree").cast("long") * (1 << 32) + F.col("node"))
    pick = lambda df: sorted((r["tree"], r["node"], r["id"]) for r in df.select("tree", "node", "id").collect())
    for n in (3, 40):
        assert pick(grow.node_samples(data, "id", ["a", "b", "c"], growing, n, 7)) == pick(sampling.node_sample(units, "id", "_unit", n, 7))


def test_votes_beside_rows_equal_appended_votes(spark):
    rng = random.Random(8)
    votes = {(row, tree): rng.randrange(3) for row in range(50) for tree in range(30) if rng.random() < 0.6}
    plain, beside = VoteStore(spark, "row", 3), VoteStore(spark, "row", 3)
    rows, want, got = spark.createDataFrame([(i, i % 3) for i in range(50)], "row long, label int"), [], []
    for first, n in ((0, 2), (2, 1), (3, 27)):
        block = [(r, r % 3, t, p) for (r, t), p in votes.items() if first <= t < first + n]
        want += plain.append(spark.createDataFrame(block, "row long, label int, tree int, pred int")).collect()
        said = spark.createDataFrame([(r, [votes.get((r, t)) for t in range(first, first + n)]) for r in range(50)], "row long, said array<int>")
        curve, rows = beside.append_beside(rows.join(said, "row"), "said", first, n)
        got += curve.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    for of in (VoteStore.votes, VoteStore.counts):
        assert sorted(map(tuple, of(beside).collect())) == sorted(map(tuple, of(plain).collect()))
