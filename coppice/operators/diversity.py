"""Diversity of ensembles, forest proximity, outliers and remoteness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.prefix import ordered, running
from coppice.plans.materialize import checkpoint, table


def pairs_of_trees(v: DataFrame, row: str = "row_id") -> DataFrame:
    """t1 < t2 with both predictions of each row: an equi-join on the row."""
    a = v.select(row, "label", F.col("tree").alias("t1"), F.col("pred").alias("p1"))
    b = v.select(row, F.col("tree").alias("t2"), F.col("pred").alias("p2"))
    return a.join(b, row).where("t1 < t2")


def q_statistic(v: DataFrame, row: str = "row_id") -> DataFrame:
    p, right, other = pairs_of_trees(v, row), F.col("p1") == F.col("label"), F.col("p2") == F.col("label")
    n = p.groupBy("t1", "t2").agg(F.count_if(right & other).alias("n11"), F.count_if(~right & ~other).alias("n00"), F.count_if(~right & other).alias("n01"), F.count_if(right & ~other).alias("n10"))
    q = F.try_divide((F.col("n11") * F.col("n00") - F.col("n01") * F.col("n10")).cast("double"), (F.col("n11") * F.col("n00") + F.col("n01") * F.col("n10")).cast("double"))
    return n.select("t1", "t2", q.alias("q"))


def pairwise_kappa(v: DataFrame, classes: int, row: str = "row_id") -> DataFrame:
    """t1, t2, kappa, mean_error."""
    p = pairs_of_trees(v, row)
    sums = [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("p1", "p2") for k in range(classes)]
    n = p.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("same"), F.avg((F.when(F.col("p1") != F.col("label"), 1.0).otherwise(0.0) + F.when(F.col("p2") != F.col("label"), 1.0).otherwise(0.0)) / 2).alias("mean_error"), *sums)
    chance = sum((F.col(f"p1_{k}") / F.col("n") * (F.col(f"p2_{k}") / F.col("n")) for k in range(classes)), F.lit(0.0))
    return n.select("t1", "t2", F.try_divide(F.col("same") / F.col("n") - chance, 1 - chance).alias("kappa"), "mean_error")


def correct_share(v: DataFrame, row: str = "row_id") -> DataFrame:
    return v.groupBy(row).agg(F.count_if(F.col("pred") == F.col("label")).alias("l"), F.count("*").alias("t"))


def interrater_kappa(v: DataFrame, row: str = "row_id") -> DataFrame:
    s = correct_share(v, row).agg(F.sum(F.col("l") * (F.col("t") - F.col("l"))).alias("mixed"), F.sum("l").alias("hits"), F.sum("t").alias("all"), F.count("*").alias("n"), F.max("t").alias("t"))
    p = F.col("hits") / F.col("all")
    return s.select((1 - F.try_divide(F.col("mixed").cast("double"), p * (1 - p) * F.col("n") * F.col("t") * (F.col("t") - 1))).alias("interrater_kappa"))


def pcdm(v: DataFrame, row: str = "row_id") -> DataFrame:
    share = F.col("l") / F.col("t")
    return correct_share(v, row).agg(F.avg(F.when(share.between(0.1, 0.9), 1.0).otherwise(0.0)).alias("pcdm"))


def leaf_patterns(v: DataFrame, trees: int, keys: tuple[str, ...] = (), row: str = "row_id") -> DataFrame:
    """pattern (the leaves of a row in all trees), *keys, n: rows of one pattern are alike to every row, so that all
    of a forest's proximities are those between patterns."""
    named = row_patterns(v, trees, keys, row)
    return named.groupBy("pattern", *keys).agg(F.count("*").alias("n"))


def row_patterns(v: DataFrame, trees: int, keys: tuple[str, ...] = (), row: str = "row_id") -> DataFrame:
    leaves = [F.max(F.when(F.col("tree") == t, F.col("leaf"))).cast("string") for t in range(trees)]
    return v.groupBy(row, *keys).agg(F.concat_ws("-", *leaves).alias("pattern"))


def cells(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern").distinct().select("pattern", F.posexplode(F.split("pattern", "-")).alias("tree", "leaf"))


def shares(a: DataFrame, b: DataFrame, trees: int) -> DataFrame:
    """i, j, prox of the patterns of a and b that share a leaf, by an equi-join on (tree, leaf)."""
    left, right = cells(a).withColumnRenamed("pattern", "i"), cells(b).withColumnRenamed("pattern", "j")
    return left.join(right, ["tree", "leaf"]).groupBy("i", "j").agg((F.count("*") / F.lit(float(trees))).alias("prox"))


def proximity(patterns: DataFrame, trees: int) -> DataFrame:
    """i <= j, prox, n_i, n_j: the share of trees in which the rows of two patterns meet; pairs that share a leaf."""
    n = patterns.groupBy("pattern").agg(F.sum("n").alias("n"))
    near = shares(patterns, patterns, trees).where("i <= j")
    return near.join(n.select(F.col("pattern").alias("i"), F.col("n").alias("n_i")), "i").join(n.select(F.col("pattern").alias("j"), F.col("n").alias("n_j")), "j").select("i", "j", "prox", "n_i", "n_j")


#: Rows of a key from which on its rows are not gathered for a join.
HEAVY_ROWS = 1 << 18


def matched(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts (a row a key). Keys of very many rows are sent to the rows, so that no task gathers them: there
    are at most a HEAVY_ROWS-th as many as rows."""
    heavy = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY_ROWS).select(*keys))
    sent = F.broadcast(facts.join(F.broadcast(heavy), keys, "left_semi"))
    own = rows.join(F.broadcast(heavy), keys, "left_semi").join(sent, keys, how)
    return own.unionByName(rows.join(F.broadcast(heavy), keys, "left_anti").join(facts, keys, how))


def pattern_outliers(rows: DataFrame, trees: int) -> DataFrame:
    """pattern, label, n, raw of rows(pattern, label): the raw score of each pattern's rows of a class, one over the sum of
    squared proximities to the class's other rows; null without any."""
    n = table(rows.where("label is not null").groupBy("pattern", "label").agg(F.count("*").alias("n")), "outlier-patterns")
    near = shares(n, n, trees)
    mine = n.select(F.col("pattern").alias("i"), "label")
    others = n.select(F.col("pattern").alias("j"), "label", "n")
    raw = near.join(mine, "i").join(others, ["j", "label"]).groupBy(F.col("i").alias("pattern"), "label").agg(F.sum(F.col("n") * F.col("prox") * F.col("prox")).alias("s"))
    return n.join(raw.select("pattern", "label", F.try_divide(F.lit(1.0), F.col("s") - 1).alias("raw")), ["pattern", "label"])


def class_deviations(raw: DataFrame, deviation: str = "absolute") -> DataFrame:
    """label, mid, dev of raw(label, raw, n: how many rows have it): the lower median, and the (lower) median absolute
    deviation from it or the standard deviation."""
    counted = raw.where("raw is not null").groupBy("label", "raw").agg(F.sum("n").alias("n"))

    def lower(of: DataFrame, value: str, out: str) -> DataFrame:
        return running(of, ["label"], value, ["n"]).where(F.col("n_upto") * 2 >= F.col("n_all")).groupBy("label").agg(F.min(value).alias(out))

    mid = checkpoint(raw.select("label").distinct().join(lower(counted, "raw", "mid"), "label", "left"))  # a row a class
    off = counted.join(F.broadcast(mid), "label")
    if deviation == "standard":
        mean = counted.groupBy("label").agg((F.sum(F.col("raw") * F.col("n")) / F.sum("n")).alias("_mean"))  # a row a class
        square = F.sum(F.pow(F.col("raw") - F.col("_mean"), 2.0) * F.col("n"))
        dev = counted.join(F.broadcast(mean), "label").groupBy("label").agg(F.sqrt(F.try_divide(square, F.sum("n") - 1)).alias("dev"))
    else:
        dev = lower(off.select("label", "n", F.abs(F.col("raw") - F.col("mid")).alias("off")), "off", "dev")
    return mid.join(F.broadcast(dev), "label", "left")


def outliers(v: DataFrame, trees: int, row: str = "row_id", deviation: str = "absolute") -> DataFrame:
    """row, label, raw, score: the raw score (see pattern_outliers) less its class's median, over its class's deviation.

    Medians are those of patterns with their counts; a row only looks its pattern up."""
    rows = table(row_patterns(v, trees, ("label",), row), "outlier-rows")
    raw = table(pattern_outliers(rows, trees), "outliers")
    both = raw.join(F.broadcast(class_deviations(raw, deviation)), "label")  # a row a class
    scores = both.select("pattern", "label", "raw", F.try_divide(F.col("raw") - F.col("mid"), F.col("dev")).alias("score"))
    return matched(rows, scores, ["pattern", "label"]).select(row, "label", "raw", "score")


def landmarks(v: DataFrame, trees: int, row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Of reference rows (votes with labels): pattern, label, n of their leaves, and label, mid, dev of their raw scores."""
    raw = table(pattern_outliers(row_patterns(v, trees, ("label",), row), trees), "outliers")
    return raw.select("pattern", "label", "n"), class_deviations(raw)


def by_proximity(v: DataFrame, probe: DataFrame, trees: int, row: str = "row_id") -> DataFrame:
    """row, prox to the one probe row (votes of it alone), nearest first: the probe itself, then by proximity, then row; rows that share no leaf with it have -1 and come last."""
    here = F.broadcast(probe.select("tree", "leaf", F.col(row).alias("_probe")))  # a row a tree
    shared = v.join(here, ["tree", "leaf"]).groupBy(row, "_probe").agg((F.count("*") / F.lit(float(trees))).alias("prox"))
    rows = v.select(row).distinct().join(shared, row, "left")
    first = F.coalesce(F.col(row) == F.col("_probe"), F.lit(False))
    return rows.withColumn("prox", F.coalesce("prox", F.lit(-1.0))).orderBy(first.desc(), F.desc("prox"), row).select(row, "prox")


def nearest(prox: DataFrame, k: int) -> DataFrame:
    """i, j, prox, rank: the k patterns nearest to each pattern; ties by name."""
    both = prox.where("i < j").select("i", "j", "prox").union(prox.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "prox"))
    order = Window.partitionBy("i").orderBy(F.desc("prox"), "j")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Leaves of a pattern, and patterns of such a leaf, that first candidates are taken from.
SEEDS, FEW = 3, 256


def nearest_patterns(patterns: DataFrame, trees: int, k: int) -> DataFrame:
    """i, j, prox, rank: the same as nearest of proximity, without all pairs of patterns that share a leaf.

    Patterns that share one of a pattern's smallest leaves (those of few patterns) are compared with it; the k-th best of them
    shares s leaves. Whoever is as near shares one of any trees - s + 1 leaves of the pattern: of its smallest ones, as only
    these are looked up. Exact, ties by name included; leaves of very many patterns are rarely looked up, and as joins of two
    tables they can be split."""
    named = ordered(patterns.select("pattern").distinct(), ["pattern"])  # _pos ascends with the name
    named = named.select(F.col("_pos").alias("id"), "pattern", F.split("pattern", "-").alias("leaves"))
    at = named.select("id", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = at.groupBy("tree", "leaf").agg(F.count("*").alias("size"))
    smallest = Window.partitionBy("id").orderBy("size", "tree")  # a row a tree
    index = table(at.join(sizes, ["tree", "leaf"]).withColumn("place", F.row_number().over(smallest)), "leaf-lists")

    def met(queries: DataFrame) -> DataFrame:
        """i, j, shared: how many leaves two patterns share that meet at a leaf of queries(i, tree, leaf)."""
        pairs = queries.join(index.select("tree", "leaf", F.col("id").alias("j")), ["tree", "leaf"]).where("i != j").select("i", "j").distinct()
        side = lambda x: named.select(F.col("id").alias(x), F.col("leaves").alias(f"{x}_leaves"))
        both = pairs.join(side("i"), "i").join(side("j"), "j")
        alike = F.zip_with("i_leaves", "j_leaves", lambda a, b: (a == b).cast("int"))
        return both.select("i", "j", F.aggregate(alike, F.lit(0), lambda s, x: s + x).alias("shared"))

    best = Window.partitionBy("i").orderBy(F.desc("shared"), "j")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    seeds = index.where((F.col("place") <= SEEDS) & (F.col("size") <= FEW)).select(F.col("id").alias("i"), "tree", "leaf")
    bound = ranked(met(seeds)).where(F.col("rank") == k).select("i", F.col("shared").alias("least"))
    wanted = index.withColumnRenamed("id", "i").join(bound, "i", "left").where(F.col("place") <= trees - F.coalesce("least", F.lit(1)) + 1).select("i", "tree", "leaf")
    found = ranked(met(wanted))
    name = lambda x: named.select(F.col("id").alias(x), F.col("pattern").alias(f"{x}_name"))
    out = found.join(name("i"), "i").join(name("j"), "j")
    return out.select(F.col("i_name").alias("i"), F.col("j_name").alias("j"), (F.col("shared") / F.lit(float(trees))).alias("prox"), "rank")


def remoteness(points: DataFrame, marks: DataFrame, stats: DataFrame, trees: int, row: str = "row_id") -> DataFrame:
    """row, remoteness: for each class of the landmarks one over the sum of squared proximities to them, less the class's
    median, over its deviation; of these the least, 0 at least.

    Classes without deviation say nothing. A row that shares no leaf with a landmark of any such class is infinitely
    remote. points: votes; marks, stats: see landmarks."""
    rows = table(row_patterns(points, trees, (), row), "remote-rows")
    near = shares(rows, marks, trees).join(marks.withColumnRenamed("pattern", "j"), "j")
    raw = near.groupBy(F.col("i").alias("pattern"), "label").agg((1 / F.sum(F.col("n") * F.col("prox") * F.col("prox"))).alias("raw"))
    scored = raw.join(stats, "label").select("pattern", F.try_divide(F.col("raw") - F.col("mid"), F.col("dev")).alias("score"))  # stats: a row a class
    least = scored.groupBy("pattern").agg(F.min("score").alias("least"))
    return matched(rows, least, ["pattern"], "left").select(row, F.greatest(F.coalesce("least", F.lit(float("inf"))), F.lit(0.0)).alias("remoteness"))
