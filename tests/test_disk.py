import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions import scalars as S
from coppice.operators import sampling, scoring, train
from coppice.plans.materialize import shared_dir


def test_noised_rows_are_shuffled_twice_in_parts(spark, monkeypatch, capsys):
    """Values dealt in many parts are those of the whole order, from bags and from arrays; nothing else is shuffled."""
    n, names = 700, ["a", "b"]
    data = [(i * 31 + 7, float(i % 13), float(i * 7 % 29), i * i % 3) for i in range(n)]
    rows = spark.createDataFrame(data, "id long, a double, b double, label int").repartition(3)
    leaf = lambda i, k: scoring.Node(i, label=k)
    trees = [scoring.Node(1, "a", 5.5, (leaf(2, 0), leaf(3, 1))), scoring.Node(1, "b", 11.5, (leaf(2, 2), scoring.Node(3, "a", 2.5, (leaf(6, 0), leaf(7, 1)))))]
    outside = {r[0]: [t for t in range(2) if (r[0] + t) % 3 != 1] for r in data}
    said = lambda t, a, b: [0 if a < 5.5 else 1, 2 if b < 11.5 else 0 if a < 2.5 else 1][t]
    own = {r[0]: r for r in data}

    def error(i):
        votes = {k: [0, 0, 0] for k in own}
        for t in range(2):
            order = [sorted((k for k in own if t in outside[k]), key=lambda k, s=s: (int(S.drawn(np.array([k]), s)[0]), k)) for s in (9, 10)]
            for k, other in zip(*order, strict=True):
                votes[k][said(t, own[other if i == 0 else k][1], own[other if i == 1 else k][2])] += 1
        asked = [k for k in own if 1 in outside[k]]
        return sum(votes[k].index(max(votes[k])) != own[k][3] for k in asked) / len(asked)

    want = {a: (error(None), error(i)) for i, a in enumerate(names)}
    monkeypatch.setattr(train, "DEALT_ROWS", 20)
    array = F.filter(F.array(F.lit(0), F.lit(1)), lambda t: (F.col("id") + t) % 3 != 1)
    in_bag = spark.createDataFrame([(t, k) for k in own for t in range(2) if t not in outside[k]], "tree int, id long")
    for found in (train.noised_importance(rows, "id", names, trees, 3, seed=9, outside=array), train.noised_importance(rows, "id", names, trees, 3, in_bag, seed=9)):
        assert {r["attribute"]: (r["error"], r["noised_error"]) for r in found.collect()} == want
        capsys.readouterr()
        found.explain()
        shuffles = [x for x in capsys.readouterr().out.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in x]
        assert len(shuffles) <= 3, shuffles  # rows twice, and the ranges


def test_boosting_keeps_rows_that_are_alike_once(spark):
    """Rows of one label and attributes, which have one weight, are drawn as one: what is written doesn't grow with them."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/coppice"
    rows = spark.range(9000).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") * 7 % 9).cast("double").alias("b"), F.when(F.col("id") % 20 < 8, 0).when(F.col("id") % 9 < 7, 1).otherwise(2).alias("label"))
    before = set(glob.glob(f"{folder}/*"))
    trees, betas = train.boost(rows, "id", ["a", "b"], 3, 3, depth=1, seed=4)
    sizes = {p: spark.read.parquet(p).count() for p in set(glob.glob(f"{folder}/*")) - before}
    assert len(trees) == len(betas) >= 1 and max(sizes.values()) <= 180


def test_boosting_weighs_rows_in_blocks(spark, monkeypatch):
    """Rows that are all different, in many blocks: draws are as many as rows and follow the weights, in any partitions."""
    monkeypatch.setattr(sampling, "BAG_BITS", 6)
    n, drawn = 3000, []
    grow = train.grow
    monkeypatch.setattr(train, "grow", lambda bag, *args, **kinds: drawn.append({r["id"]: r["_weights"][0] for r in bag.collect()}) or grow(bag, *args, **kinds))
    rows = spark.range(n).select("id", (F.col("id") * 0.5).alias("a"), F.when(F.col("id") < 1000, 0).when(F.col("id") % 10 == 3, 1).otherwise(2).alias("label"))
    trees, betas = train.boost(rows, "id", ["a"], 3, 2, depth=1, seed=4)
    again = train.boost(rows.repartition(7), "id", ["a"], 3, 2, depth=1, seed=4)
    assert again == (trees, betas) and drawn[:2] == drawn[2:] and [sum(x.values()) for x in drawn[:2]] == [n, n]
    (cut,) = {trees[0].threshold}
    wrong = {i for i in range(n) if (0 if i < 1000 else 1 if i % 10 == 3 else 2) != trees[0].children[int(i * 0.5 >= cut)].label}
    assert betas[0] == pytest.approx(len(wrong) / (n - len(wrong)))
    # after the first tree its errors have half of the weight
    share = sum(x for i, x in drawn[1].items() if i in wrong) / n
    assert 0 < len(wrong) < n / 4 and abs(share - 0.5) < 5 * math.sqrt(0.25 / n)


def test_shares_follow_the_multinomial_law():
    weights = [0, 5, 1, 4, 0]
    found = np.array([sampling.shared(weights, 40, seed, 2) for seed in range(400)])
    assert (found.sum(axis=1) == 40).all() and not found[:, [0, 4]].any() and (found[0] == sampling.shared(weights, 40, 0, 2)).all()
    expected = 400 * 40 * np.array([0.5, 0.1, 0.4])
    assert ((found.sum(axis=0)[1:4] - expected) ** 2 / expected).sum() < 13.8  # 0.999 of 2 degrees
    assert abs(found[:, 1].var() - 10) < 3 and not sampling.shared([0, 0], 5, 1).any() and not len(sampling.shared([], 5, 1))
