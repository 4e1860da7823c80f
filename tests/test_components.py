"""Components against union-find, and how many tasks they leave the driver to keep."""

import random

from pyspark.sql import functions as F

from coppice.operators import graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(x, find(x)) for x in root}


def tasks_of(spark, name, work):
    """Tasks of the stages that ran, of the jobs that work starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    found = [tracker.getStageInfo(s) for s in stages]
    return out, sum(x.numCompletedTasks for x in found if x)


def test_components_equal_union_find(spark):
    draw = random.Random(5)
    shapes = [
        [(i, i + 1) for i in range(300)],  # a chain
        [(0, i) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1200)],  # stars
        [(draw.randrange(900), draw.randrange(900)) for _ in range(700)],
        [(7, 7)],  # a node alone isn't part of an edge
    ]
    for edges in shapes:
        found = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        want = plain([e for e in edges if e[0] != e[1]])
        assert len(found) == len(want) and {(r["node"], r["component"]) for r in found} == want


def test_stars_take_no_round(spark):
    stars = spark.range(1, 4000).select(F.col("id").alias("a"), (F.col("id") % 9 * -1).alias("b"))
    found, tasks = tasks_of(spark, "stars", lambda: graph.components(stars, "a", "b").count())
    assert found == 3999 + 9
    assert tasks <= 30
