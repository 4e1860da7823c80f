import random

import pytest

from coppice.operators import metrics


def test_class_windows_slide_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK", 128)
    rng = random.Random(6)
    for n in (30, 70, 100, 700):
        data = [(i, rng.randrange(2), round(rng.random(), 1), rng.random()) for i in range(n)]
        rows = spark.createDataFrame(data, "id long, label int, p0 double, p1 double").repartition(7)
        got = {r["class"]: (r["calibration"], r["refinement"]) for r in metrics.class_windows(rows, ["p0", "p1"], "label", "id").collect()}
        width, each = 50 if n < 100 else 100, []
        for k in range(2):
            line = [(x[2 + k], float(x[1] == k)) for x in sorted(data, key=lambda x: (x[2 + k], x[0]))]
            parts = [line[i : i + width] for i in range(n - width + 1)]
            means = [(sum(x for x, _ in p) / width, sum(y for _, y in p) / width) for p in parts]
            each.append((sum(abs(m - r) for m, r in means) / len(means), sum(r * (1 - r) for _, r in means) / len(means)) if means else (None, None))
        want = {0: each[0], 1: each[1], None: tuple(None if each[0][j] is None else (each[0][j] + each[1][j]) / 2 for j in range(2))}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k] == (w if w[0] is None else pytest.approx(w))


def test_class_windows_slide_by_arrays(spark):
    """No window of Spark's is slid over the rows: a task of a plan has a row a task and class in its windows."""
    rows = spark.createDataFrame([(1, 0, 0.5)], "id long, label int, p0 double")
    plan = metrics.class_windows(rows, ["p0"], "label", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "currentrow$(), 99" not in plan
