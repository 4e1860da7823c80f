"""Metrics of predictions: confusion, probability scores, ranking and calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.prefix import ordered, running


def confusion(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or []), "pred", "label").agg(F.count("*").alias("n"))


def class_table(rows: DataFrame, classes: int) -> DataFrame:
    """class, n, precision, recall, f_measure from label and pred; 0 where undefined."""
    sums = rows.agg(*[x for k in range(classes) for x in (F.count_if(F.col("label") == k).alias(f"n{k}"), F.count_if(F.col("pred") == k).alias(f"m{k}"), F.count_if((F.col("label") == k) & (F.col("pred") == k)).alias(f"h{k}"))])
    parts = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"n{k}").alias("n"), F.coalesce(F.try_divide(F.col(f"h{k}"), F.col(f"m{k}")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col(f"h{k}"), F.col(f"n{k}")), F.lit(0.0)).alias("recall")) for k in range(classes)])
    out = sums.select(F.explode(parts).alias("x")).select("x.*")
    f = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f_measure", f)


def brier(p: list[Column], label: Column) -> Column:
    parts = [F.pow(F.when(label == k, 1.0).otherwise(0.0) - x, 2.0) for k, x in enumerate(p)]
    return sum(parts[1:], parts[0])


def nce(p: list[Column], label: Column) -> Column:
    mine = F.lit(0.0)
    for k, x in enumerate(p):
        mine = F.when(label == k, x).otherwise(mine)
    return -F.log2(F.greatest(mine, F.lit(1e-6)))


def measures(rows: DataFrame, classes: int) -> DataFrame:
    """scope, class, n, accuracy, precision, f_measure, brier, nce of rows(label, pred, p0..): of each class (accuracy: of
    its rows, its recall), overall (all rows) and the mean of the classes that have rows."""
    p = [F.col(f"p{k}") for k in range(classes)]
    scores = rows.groupBy(F.col("label").alias("class")).agg(F.sum(brier(p, F.col("label"))).alias("b"), F.sum(nce(p, F.col("label"))).alias("e"), F.count_if(F.col("pred") == F.col("label")).alias("hits"))
    each = class_table(rows, classes).join(scores, "class", "left")  # a row a class
    one = each.select(F.lit("class").alias("scope"), F.col("class").cast("int"), "n", F.col("recall").alias("accuracy"), "precision", "f_measure", F.try_divide("b", "n").alias("brier"), F.try_divide("e", "n").alias("nce"))
    sums = each.agg(F.sum("n").alias("n"), F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy"), F.try_divide(F.sum("b"), F.sum("n")).alias("brier"), F.try_divide(F.sum("e"), F.sum("n")).alias("nce"))
    whole = sums.select(F.lit("overall").alias("scope"), F.lit(None).cast("int").alias("class"), "n", "accuracy", F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("f_measure"), "brier", "nce")
    mean = one.where("n > 0").agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("accuracy", "precision", "f_measure", "brier", "nce")])
    return one.unionByName(whole).unionByName(mean.select(F.lit("mean").alias("scope"), F.lit(None).cast("int").alias("class"), "n", "accuracy", "precision", "f_measure", "brier", "nce"))


def class_stats(confusions: DataFrame) -> DataFrame:
    """class, n, recall, precision of the sum of confusions (pred, label, n; one or more for each fold)."""
    own = confusions.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("hits"))
    said = confusions.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("said"))
    both = own.join(said, "class", "full")
    return both.select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)).alias("precision"))


def confusion_text(confusion: DataFrame, names: list[str]) -> str:
    """A confusion as text: a row a truth, a column a prediction."""
    n = {(r["label"], r["pred"]): r["n"] for r in confusion.groupBy("label", "pred").agg(F.sum("n").alias("n")).collect()}  # classes squared
    cells = [["truth", *names]] + [[name, *[str(n.get((i, j), 0)) for j in range(len(names))]] for i, name in enumerate(names)]
    width = [max(len(row[j]) for row in cells) for j in range(len(names) + 1)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(row, width, strict=True)) for row in cells) + "\n"


def auroc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """auroc of a score (Mann-Whitney, ties half) from counts by distinct score, in a two-level scan of the scores."""
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    by = running(by, [], "s", ["neg"]).withColumn("won", F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return by.agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


#: Places of a block of calibration windows.
BLOCK = 1 << 14


def windows(rows: DataFrame, score: str, positive: Column, order: str, width: int = 100) -> DataFrame:
    """calibration and refinement over sliding windows of the rows by score, then order (a number): mean |mean score - rate|
    and mean rate (1 - rate). Null where there are fewer rows than a window holds.

    Rows are numbered once, by score and order together, and dealt to blocks of BLOCK places; each block also gets the first
    rows of the next, so that its windows are whole."""
    at = rows.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(order).alias("o"), F.when(positive, 1.0).otherwise(0.0).alias("hit"), F.lit(1).alias("one"))
    at = running(at, [], "s", ["one"], ["o"]).select("s", "hit", (F.col("one_upto") - 1).alias("at"))
    block = F.floor(F.col("at") / BLOCK)
    to = F.when((F.col("at") % BLOCK < width - 1) & (F.col("at") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    frame = Window.partitionBy("block").orderBy("at").rowsBetween(0, width - 1)
    slid = at.withColumn("block", F.explode(to)).select("block", "at", F.avg("s").over(frame).alias("mean"), F.avg("hit").over(frame).alias("rate"), F.count("*").over(frame).alias("n"))
    full = slid.where((F.col("n") == width) & (F.floor(F.col("at") / BLOCK) == F.col("block")))
    return full.agg(F.avg(F.abs(F.col("mean") - F.col("rate"))).alias("calibration"), F.avg(F.col("rate") * (1 - F.col("rate"))).alias("refinement"))


def class_windows(rows: DataFrame, scores: list[str], label: str, order: str) -> DataFrame:
    """class, calibration, refinement of each class's score (by its number), and their mean over the classes (class null).

    Windows hold 100 rows, of fewer than 100 rows 50; of fewer than 50 all values are null. All classes are numbered in one go:
    written along class, score and order, a task's rows follow those of the tasks before it. Their windows are slid by arrays in
    blocks of BLOCK places, each with the first rows of the next."""
    at = rows.select(F.col(label).alias("label"), F.col(order).alias("o"), F.posexplode(F.array(*scores)).alias("class", "s")).where("s is not null")
    at = ordered(at.select("class", F.col("s").cast("double").alias("s"), "o", F.when(F.col("label") == F.col("class"), 1.0).otherwise(0.0).alias("hit")), ["class", "s", "o"])
    own = at.groupBy("class", "_task").agg(F.count("*").alias("_n"), F.min("_pos").alias("_low"))
    along, whole = Window.partitionBy("class").orderBy("_task"), Window.partitionBy("class")
    first = own.select("class", "_task", (F.sum("_n").over(along) - F.col("_n") - F.col("_low")).alias("_first"), F.sum("_n").over(whole).alias("_all"))  # a row a task and class
    at = at.join(F.broadcast(first), ["class", "_task"]).select("class", "s", "hit", (F.col("_pos") + F.col("_first")).alias("at"), F.when(F.col("_all") < 100, 50).otherwise(100).alias("width"))
    block = F.floor(F.col("at") / BLOCK)
    to = F.when((F.col("at") % BLOCK < 99) & (F.col("at") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))

    def slide(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        width, start = own["width"][0].as_py(), key[1].as_py() * BLOCK
        n = max(0, min(own.num_rows - width + 1, BLOCK)) if own["at"][0].as_py() == start else 0  # windows that begin in the block
        sums = [np.concatenate([[0.0], np.cumsum(own[c].to_numpy())]) for c in ("s", "hit")]
        mean, rate = ((x[width:][:n] - x[:-width][:n]) / width for x in sums)
        return pa.table({"class": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "off": [float(np.abs(mean - rate).sum())], "spread": [float((rate * (1 - rate)).sum())]})

    dealt = at.withColumn("block", F.explode(to))
    slid = dealt.groupBy("class", "block").applyInArrow(slide, "class int, n long, off double, spread double")
    each = slid.groupBy("class").agg(F.try_divide(F.sum("off"), F.sum("n")).alias("calibration"), F.try_divide(F.sum("spread"), F.sum("n")).alias("refinement"))
    return each.unionByName(each.agg(F.lit(None).cast("int").alias("class"), F.avg("calibration").alias("calibration"), F.avg("refinement").alias("refinement")))
