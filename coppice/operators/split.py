"""Split search: class histograms by value, a running scan, and the criteria as column expressions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scalars import log2
from coppice.operators.prefix import running


def total(counts: list[Column]) -> Column:
    return sum(counts[1:], counts[0])


def entropy(counts: list[Column]) -> Column:
    n = total(counts).cast("double")
    return F.when(n > 0, log2(n) - total([c * log2(c.cast("double")) for c in counts]) / F.greatest(n, F.lit(1.0))).otherwise(0.0)


def information_gain(branches: list[list[Column]]) -> Column:
    sizes = [total(b).cast("double") for b in branches]
    n = total(sizes)
    whole = [total([b[k] for b in branches]) for k in range(len(branches[0]))]
    return entropy(whole) - total([s / n * entropy(b) for s, b in zip(sizes, branches, strict=True)])


def split_info(branches: list[list[Column]]) -> Column:
    return entropy([total(b) for b in branches])


def hellinger(branches: list[list[Column]]) -> Column:
    """Mean over the pairs of classes that are both present of the distance of their branch distributions."""
    k = len(branches[0])
    sums = [total([b[c] for b in branches]).cast("double") for c in range(k)]
    distances, present = [], []
    for a, b in itertools.combinations(range(k), 2):
        both = (sums[a] > 0) & (sums[b] > 0)
        terms = [F.pow(F.sqrt(x[a] / F.greatest(sums[a], F.lit(1.0))) - F.sqrt(x[b] / F.greatest(sums[b], F.lit(1.0))), 2.0) for x in branches]
        distances.append(F.when(both, F.sqrt(total(terms))).otherwise(0.0))
        present.append(F.when(both, 1).otherwise(0))
    n = total(present)
    return F.when(n > 0, total(distances) / F.greatest(n, F.lit(1))).otherwise(0.0)


def least_branch(n: Column, classes: int, fixed: int = 2, dynamic: bool = True) -> Column:
    """Fewest rows of a branch: a tenth of n over the classes, from fixed to 25."""
    m = F.floor(n * 0.1 / classes)
    return F.when(m <= fixed, fixed).when(m > 25, 25).otherwise(m).cast("int") if dynamic else F.lit(fixed)


def histogram(rows: DataFrame, keys: list[str], classes: int, label: str = "label", weight: Column | None = None) -> DataFrame:
    """keys, attribute, value, c0.. : class counts of each value; partial sums before the shuffle."""
    w = F.lit(1) if weight is None else weight
    return rows.groupBy(*keys, "attribute", "value").agg(*[F.sum(F.when(F.col(label) == k, w).otherwise(0)).alias(f"c{k}") for k in range(classes)])


def candidates(hist: DataFrame, keys: list[str], classes: int, fixed: int = 2, dynamic: bool = True) -> DataFrame:
    """Cuts between adjacent present values whose branches hold enough rows: keys, attribute, low, threshold,
    l0.. (left), r0.. (right), n. Rows without a value take no part; a null value belongs to no cut's left branch."""
    counts = [f"c{k}" for k in range(classes)]
    rows = running(hist.where("value is not null"), [*keys, "attribute"], "value", counts).where("next is not null")
    rows = rows.select(*keys, "attribute", F.col("value").alias("low"), ((F.col("value") + F.col("next")) / 2).alias("threshold"), *[F.col(f"{c}_upto").alias(f"l{k}") for k, c in enumerate(counts)], *[(F.col(f"{c}_all") - F.col(f"{c}_upto")).alias(f"r{k}") for k, c in enumerate(counts)])
    nl, nr = total([F.col(f"l{k}") for k in range(classes)]), total([F.col(f"r{k}") for k in range(classes)])
    least = least_branch(nl + nr, classes, fixed, dynamic)
    return rows.withColumn("n", nl + nr).where((nl >= least) & (nr >= least))


def scored(gain: Column, info: Column, penalty: Column, criterion: str) -> Column:
    """A split's score by the criterion: infogain the gain, gainratio over the split info, c45 less the penalty and, if
    positive, over the split info, hellinger less the penalty and, if positive, over sqrt 2."""
    less = gain - penalty
    return {
        "infogain": gain,
        "gainratio": F.try_divide(gain, info),
        "c45": F.when(less > 0, F.try_divide(less, info)).otherwise(less),
        "hellinger": F.when(less > 0, less / math.sqrt(2)).otherwise(less),
    }[criterion]


def best_cuts(cuts: DataFrame, keys: list[str], classes: int, criterion: str) -> DataFrame:
    """Best cut of each attribute: keys, attribute, threshold, score, l0.., r0...

    infogain: largest gain; gainratio: largest gain / split info; c45: the cut of largest gain, less
    log2(candidates) / n, if positive over split info; hellinger: likewise with the distance, over sqrt 2. The lowest
    value wins ties. One aggregation: the best is the least of structs, so that it is found before the shuffle too.
    """
    branches = [[F.col(f"l{k}") for k in range(classes)], [F.col(f"r{k}") for k in range(classes)]]
    measure = hellinger(branches) if criterion == "hellinger" else information_gain(branches)
    rows = cuts.withColumn("gain", measure).withColumn("info", split_info(branches))
    chosen = F.round("gain", 9) if criterion != "gainratio" else F.round(F.try_divide("gain", "info"), 9)
    sides = [f"{x}{k}" for x in "lr" for k in range(classes)]
    best = rows.groupBy(*keys, "attribute").agg(F.count("*").alias("tried"), F.min(F.struct((-chosen).alias("order"), "low", "threshold", "gain", "info", "n", *sides)).alias("b"))
    best = best.select(*keys, "attribute", "tried", "b.*")
    score = scored(F.col("gain"), F.col("info"), F.log2(F.col("tried").cast("double")) / F.col("n"), criterion)
    return best.select(*keys, "attribute", "threshold", score.alias("score"), *sides)


def cut_ends(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attribute, a, z (the first and the last cut), tried, n of each attribute."""
    return cuts.groupBy(*keys, "attribute").agg(F.min("threshold").alias("a"), F.max("threshold").alias("z"), F.count("*").alias("tried"), F.first("n").alias("n"))


def extremely_random_cuts(hist: DataFrame, cuts: DataFrame, keys: list[str], classes: int, u: Column) -> DataFrame:
    """One cut for each attribute, the share u (in [0, 1), of the keys and attribute) of the way from its first candidate
    to its last: keys, attribute, threshold, score (as c45's, whether positive or not), l0.. (left)."""
    ends = cut_ends(cuts, keys).withColumn("threshold", F.col("a") + (F.col("z") - F.col("a")) * u)
    below = F.col("value") < F.col("threshold")
    both = hist.where("value is not null").join(ends, [*keys, "attribute"])
    sides = both.groupBy(*keys, "attribute", "threshold", "tried", "n").agg(*[F.sum(F.when(below, F.col(f"c{k}")).otherwise(0)).alias(f"l{k}") for k in range(classes)], *[F.sum(F.when(below, 0).otherwise(F.col(f"c{k}"))).alias(f"r{k}") for k in range(classes)])
    branches = [[F.col(f"{x}{k}") for k in range(classes)] for x in "lr"]
    score = F.try_divide(information_gain(branches) - F.log2(F.col("tried").cast("double")) / F.col("n"), split_info(branches))
    return sides.select(*keys, "attribute", "threshold", score.alias("score"), *[f"l{k}" for k in range(classes)])


def totally_random_cuts(cuts: DataFrame, keys: list[str], u: Column, score: Column) -> DataFrame:
    """One cut for each attribute at a random place and of a random score: keys, attribute, threshold, score."""
    return cut_ends(cuts, keys).select(*keys, "attribute", (F.col("a") + (F.col("z") - F.col("a")) * u).alias("threshold"), score.alias("score"))


def discrete_splits(hist: DataFrame, keys: list[str], classes: int, criterion: str, fixed: int = 2, dynamic: bool = True) -> DataFrame:
    """A branch for each value: keys, attribute, threshold (null), score of discrete attributes whose largest branch
    leaves enough rows to the others. Rows without a value take no part."""
    c = [F.col(f"c{k}") for k in range(classes)]
    rows = hist.where("value is not null").withColumn("size", total(c).cast("double"))
    whole = [F.sum(f"c{k}").alias(f"w{k}") for k in range(classes)]
    w = [F.col(f"w{k}") for k in range(classes)]
    found = rows.groupBy(*keys, "attribute").agg(*whole, F.sum("size").alias("n"), F.max("size").alias("most"), F.sum(F.col("size") * entropy(c)).alias("within"), F.sum(F.col("size") * log2(F.col("size"))).alias("sizes"))
    if criterion == "hellinger":
        found = found.join(discrete_hellinger(rows, keys, classes), [*keys, "attribute"])
        gain = F.col("distance")
    else:
        gain = entropy(w) - F.col("within") / F.col("n")
    info = log2(F.col("n")) - F.col("sizes") / F.col("n")
    found = found.where(F.col("most") <= F.col("n") - least_branch(F.col("n"), classes, fixed, dynamic))
    score = F.try_divide(gain, info) if criterion in ("gainratio", "c45") else gain / math.sqrt(2) if criterion == "hellinger" else gain
    return found.select(*keys, "attribute", F.lit(None).cast("double").alias("threshold"), score.alias("score"))


def discrete_hellinger(rows: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """keys, attribute, distance: mean over pairs of present classes of the distance of their distributions over values.

    The squared distance of two distributions is 2 less twice the sum of the roots of their products."""
    pairs = list(itertools.combinations(range(classes), 2))
    sums = rows.groupBy(*keys, "attribute").agg(*[F.sum(f"c{k}").cast("double").alias(f"w{k}") for k in range(classes)], *[F.sum(F.sqrt(F.col(f"c{a}").cast("double") * F.col(f"c{b}"))).alias(f"x{a}_{b}") for a, b in pairs])
    both = {(a, b): (F.col(f"w{a}") > 0) & (F.col(f"w{b}") > 0) for a, b in pairs}
    apart = [F.when(both[a, b], F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col(f"x{a}_{b}") / F.sqrt(F.greatest(F.col(f"w{a}") * F.col(f"w{b}"), F.lit(1.0)))))).otherwise(0.0) for a, b in pairs]
    present = total([F.when(both[p], 1).otherwise(0) for p in pairs])
    return sums.select(*keys, "attribute", F.when(present > 0, total(apart) / F.greatest(present, F.lit(1))).otherwise(0.0).alias("distance"))


def best_attribute(cuts: DataFrame, keys: list[str], zero_gain: bool = False) -> DataFrame:
    """The attribute of largest positive score, the lowest index of ties; with zero_gain of any score."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "attribute")
    return cuts.where("score is not null" if zero_gain else "score > 1e-9").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def laplace(counts: list[Column]) -> list[Column]:
    return [(c + 1) / (total(counts) + len(counts)) for c in counts]


def majority(counts: list[Column]) -> Column:
    listed = F.array(*counts)
    return (F.array_position(listed, F.array_max(listed)) - 1).cast("int")
