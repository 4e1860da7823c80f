"""Scoring: trees as expressions, votes as a long table, ensemble rules as aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scalars import draw


@dataclass(frozen=True)
class Node:
    """A leaf (label, counts) or a branch on attribute: value < threshold goes to children[0]; a discrete attribute
    (threshold None) has a child for each code."""

    id: int
    attribute: str | None = None
    threshold: float | None = None
    children: tuple["Node", ...] = ()
    label: int = 0
    counts: tuple[int, ...] = field(default=())
    seen: bool = True  # False: an empty branch, whose counts are its parent's


#: Nodes, and levels, of an ensemble that is scored as one expression; larger ones are scored from flat arrays, which took a
#: third of the time for two trees of 181 nodes (sizes between weren't tried).
FEW_NODES, FEW_LEVELS = 64, 24


@dataclass(frozen=True)
class Flat:
    """A tree as arrays: attribute (number, -1 at leaves), threshold (nan: discrete), first child, number of children."""

    attribute: np.ndarray
    threshold: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def walk(self, values: np.ndarray) -> np.ndarray:
        """The node that each row of values ends at; nulls are nan."""
        at = np.zeros(len(values), np.int64)
        rows = np.arange(len(values)) if len(self.attribute) and self.attribute[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            here = at[rows]
            x, cut = values[rows, self.attribute[here]], self.threshold[here]
            last = self.children[here] - 1
            code = np.where((x >= 0) & (x < last), x, last).astype(np.int64)
            at[rows] = self.first[here] + np.where(np.isnan(cut), code, np.where(x < cut, 0, 1))
            rows = rows[self.attribute[at[rows]] >= 0]
        return at


def matrix(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Numeric columns as one array, nulls as nan."""
    out = np.empty((rows, len(columns)))
    for i, c in enumerate(columns):
        out[:, i] = c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    return out


def flatten(tree: Node, attributes: list[str]) -> tuple[Flat, list[Node]]:
    """A tree as arrays, children of a node next to each other, and the nodes in that order."""
    nodes, first = [tree], []
    for node in nodes:  # grows meanwhile
        first.append(len(nodes))
        nodes.extend(node.children)
    number = {a: i for i, a in enumerate(attributes)}
    return Flat(np.array([-1 if n.attribute is None else number[n.attribute] for n in nodes], np.int64), np.array([np.nan if n.threshold is None else n.threshold for n in nodes], np.float64), np.array(first, np.int64), np.array([len(n.children) for n in nodes], np.int64)), nodes


def used_attributes(trees: list[Node]) -> list[str]:
    found: dict[str, None] = {}
    todo = list(trees)
    while todo:
        node = todo.pop()
        if node.attribute is not None:
            found.setdefault(node.attribute)
            todo.extend(node.children)
    return sorted(found)


def leaf_probabilities(node: Node, classes: int) -> list[float]:
    """Laplace estimates of a leaf's counts; without counts, 1 for its class."""
    n = sum(node.counts)
    return [(c + 1) / (n + classes) for c in node.counts] if node.counts else [float(k == node.label) for k in range(classes)]


def number(x: float) -> str:
    return f"double('{float(x)!r}')"


def walk(node: Node, classes: int) -> Column:
    """struct(leaf, label, probs): one generated expression for the whole tree, no join and no Python."""

    def said(node: Node) -> str:
        if node.attribute is None:
            return f"named_struct('leaf', {node.id}, 'label', {node.label}, 'probs', array({', '.join(map(number, leaf_probabilities(node, classes)))}))"
        name = "`" + node.attribute.replace("`", "``") + "`"
        tests = [f"{name} < {number(node.threshold)}"] if node.threshold is not None else [f"{name} = {code}" for code in range(len(node.children) - 1)]
        branches = " ".join(f"when {test} then {said(child)}" for test, child in zip(tests, node.children, strict=False))
        return f"case {branches} else {said(node.children[-1])} end"

    return F.expr(said(node))


@dataclass(frozen=True)
class Packed:
    """An ensemble as arrays: the attributes it uses, and of each tree its shape, its nodes' ids, labels and probabilities."""

    attributes: list[str]
    trees: list[tuple[Flat, np.ndarray, np.ndarray, np.ndarray]]


def packed(trees: list[Node], classes: int) -> Packed:
    attributes, out = used_attributes(trees), []
    for tree in trees:
        flat, nodes = flatten(tree, attributes)
        counts = np.array([n.counts or (0,) * classes for n in nodes], np.float64)
        labels = np.array([n.label for n in nodes], np.int32)
        probs = (counts + 1) / (counts.sum(axis=1, keepdims=True) + classes)
        bare = np.array([not n.counts for n in nodes])
        probs[bare] = labels[bare, None] == np.arange(classes)
        out.append((flat, np.array([n.id for n in nodes]), labels, probs))
    return Packed(attributes, out)


def few(trees: list[Node]) -> bool:
    """Whether an ensemble is scored as one expression: it has FEW_NODES nodes and FEW_LEVELS levels at most."""
    left = FEW_NODES
    for tree in trees:
        n, level = 0, [tree]
        while level:
            n, left = n + 1, left - len(level)
            if left < 0 or n > FEW_LEVELS:
                return False
            level = [c for node in level for c in node.children]
    return True


def votes(rows: DataFrame, keep: list[str], trees: list[Node], classes: int, arrays: Packed | None = None) -> DataFrame:
    """keep, tree, leaf, pred, probs: one row for each row and tree. arrays: the packed trees, if they are at hand."""
    if arrays or not few(trees):
        return walked(rows, keep, trees, classes, arrays)
    each = F.array(*[F.struct(F.lit(t).alias("tree"), walk(tree, classes).alias("at")) for t, tree in enumerate(trees)])
    return rows.select(*keep, F.explode(each).alias("v")).select(*keep, "v.tree", F.col("v.at.leaf").alias("leaf"), F.col("v.at.label").alias("pred"), F.col("v.at.probs").alias("probs"))


def nodes_of(tree: Node) -> list[Node]:
    """The nodes of a tree, parents before their children, however deep it is."""
    nodes = [tree]
    for node in nodes:  # grows meanwhile
        nodes.extend(node.children)
    return nodes


def node_count(tree: Node) -> int:
    return len(nodes_of(tree))


def levels(tree: Node) -> int:
    """Nodes on the longest way from the root."""
    n, level = 0, [tree]
    while level:
        n, level = n + 1, [c for node in level for c in node.children]
    return n


def walked(rows: DataFrame, keep: list[str], trees: list[Node], classes: int, arrays: Packed | None = None) -> DataFrame:
    """The same as votes from flat arrays that are sent to the tasks."""
    arrays = arrays or packed(trees, classes)
    sent = rows.sparkSession.sparkContext.broadcast(arrays.trees)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = matrix(batch.columns[len(keep) :], n)
            for t, (flat, ids, labels, probs) in enumerate(sent.value):
                at = flat.walk(values)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * classes + 1, classes, dtype=np.int32)), pa.array(probs[at].reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.full(n, t, np.int32)), pa.array(ids[at].astype(np.int32)), pa.array(labels[at]), listed], [*keep, "tree", "leaf", "pred", "probs"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.select(*keep, *[F.col(a).cast("double").alias(f"a_{i}") for i, a in enumerate(arrays.attributes)]).mapInArrow(vote, f"{kinds}tree int, leaf int, pred int, probs array<double>")


def tallies(rows: DataFrame, keep: list[str], trees: list[Node], classes: int, weights: list[float] | None = None, arrays: Packed | None = None) -> DataFrame:
    """keep, v0.. (votes), p0.. (mean leaf probabilities) of every row, weighted by weights (one a tree).

    The same as tally of votes, where keep tells rows apart, but without a shuffle: all trees vote on a row where it is."""
    weights = [1.0] * len(trees) if weights is None else weights
    names = [f"{x}{k}" for x in "vp" for k in range(classes)]
    if not arrays and few(trees):
        said = rows.select(*keep, *[walk(tree, classes).alias(f"_said_{t}") for t, tree in enumerate(trees)])
        at = [F.col(f"_said_{t}") for t in range(len(trees))]
        cast = [sum(F.when(x["label"] == k, w).otherwise(0.0) for x, w in zip(at, weights, strict=True)) for k in range(classes)]
        mean = [sum(x["probs"][k] * w for x, w in zip(at, weights, strict=True)) / sum(weights) for k in range(classes)]
        return said.select(*keep, *[x.alias(n) for n, x in zip(names, cast + mean, strict=True)])
    arrays = arrays or packed(trees, classes)
    sent = rows.sparkSession.sparkContext.broadcast(arrays.trees)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values, cast, mean = matrix(batch.columns[len(keep) :], n), np.zeros((classes, n)), np.zeros((classes, n))
            for w, (flat, _, labels, probs) in zip(weights, sent.value, strict=True):
                at = flat.walk(values)
                cast[labels[at], np.arange(n)] += w
                mean += w * probs[at].T
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, cast), *map(pa.array, mean / sum(weights))], [*keep, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.select(*keep, *[F.col(a).cast("double").alias(f"a_{i}") for i, a in enumerate(arrays.attributes)]).mapInArrow(add, kinds + ", ".join(f"{n} double" for n in names))


def said(rows: DataFrame, keep: list[str], trees: list[Node], classes: int, out: str = "said", weights: str | None = None) -> DataFrame:
    """keep and an array of what each tree says of the row, where the row is; null where its weight (weights: an array a row) isn't 0."""
    if few(trees) and not weights:
        return rows.select(*keep, F.array(*[walk(tree, classes)["label"] for tree in trees]).alias(out))
    attributes = used_attributes(trees)
    sent = rows.sparkSession.sparkContext.broadcast([(flat, np.array([n.label for n in nodes], np.int32)) for flat, nodes in (flatten(t, attributes) for t in trees)])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.columns[len(keep) :], batch.num_rows)
            found = np.stack([labels[flat.walk(values)] for flat, labels in sent.value], axis=1).reshape(-1)
            inside = batch.column(keep.index(weights)).flatten().to_numpy() != 0 if weights else None
            offsets = pa.array(np.arange(0, found.size + 1, len(sent.value), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(offsets, pa.array(found, mask=inside))], [*keep, out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.select(*keep, *[F.col(a).cast("double").alias(f"a_{i}") for i, a in enumerate(attributes)]).mapInArrow(vote, f"{kinds}`{out}` array<int>")


def own_votes(rows: DataFrame, trees: list[Node], classes: int) -> DataFrame:
    """rows with pred: what the tree that the column tree numbers says of each."""
    attributes = used_attributes(trees)
    sent = rows.sparkSession.sparkContext.broadcast([(flat, np.array([n.label for n in nodes], np.int32)) for flat, nodes in (flatten(t, attributes) for t in trees)])
    names = rows.columns

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.columns[len(names) :], batch.num_rows)
            tree = batch.column(names.index("tree")).to_numpy()
            pred = np.zeros(batch.num_rows, np.int32)
            for t in np.unique(tree):
                flat, labels = sent.value[t]
                pred[tree == t] = labels[flat.walk(values[tree == t])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pred)], [*names, "pred"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.select(*names, *[F.col(a).cast("double").alias(f"a_{i}") for i, a in enumerate(attributes)]).mapInArrow(vote, f"{kinds}pred int")


def tally(v: DataFrame, keep: list[str], classes: int, weight: Column | None = None) -> DataFrame:
    """keep, v0.. (votes), p0.. (mean leaf probabilities); weighted for boosted ensembles."""
    w = F.lit(1.0) if weight is None else weight
    return v.groupBy(*keep).agg(*[F.sum(F.when(F.col("pred") == k, w).otherwise(0.0)).alias(f"v{k}") for k in range(classes)], *[(F.sum(w * F.col("probs")[k]) / F.sum(w)).alias(f"p{k}") for k in range(classes)])


def winner(columns: list[Column], key: Column | None = None, seed: int = 1) -> Column:
    """The class of most votes; ties go to the lowest class, or with a key to a portable random one of them."""
    listed = F.array(*[F.round(c, 9) for c in columns])
    if key is None:
        return (F.array_position(listed, F.array_max(listed)) - 1).cast("int")
    tied = F.filter(F.transform(listed, lambda x, i: F.when(x == F.array_max(listed), i)), lambda x: x.isNotNull())
    return F.element_at(tied, (draw(key, seed) % F.size(tied) + 1).cast("int")).cast("int")


def boosted_probabilities(v: DataFrame, keep: list[str], betas: list[float], classes: int) -> DataFrame:
    """keep, p0..: the trees' probabilities weighted by their betas over all betas."""
    weight = F.element_at(F.array(*[F.lit(float(b)) for b in betas]), F.col("tree") + 1)
    return v.groupBy(*keep).agg(*[(F.sum(weight * F.col("probs")[k]) / F.sum(weight)).alias(f"p{k}") for k in range(classes)])


def vote_share(columns: list[Column]) -> list[Column]:
    """Unweighted probabilities: each class's share of the votes."""
    return [F.try_divide(c, sum(columns[1:], columns[0])) for c in columns]


def margin(columns: list[Column]) -> Column:
    down = F.sort_array(F.array(*columns), asc=False)
    return down[0] - down[1]


def combine(per_ensemble: DataFrame, keep: list[str], classes: int, rule: str, seen: DataFrame | None = None) -> DataFrame:
    """One row for keep: pred and s0.. by a rule over the ensembles' votes (keep, ensemble, v0..).

    mmv pools all trees; emv gives each ensemble one vote; memv adds the winner's margin over the second, by trees; pmv
    divides an ensemble vote by the ensembles that saw the class, spmv by the class's shares summed over ensembles
    (seen: ensemble, n0.. training counts, one row each).
    """
    v = [F.col(f"v{k}") for k in range(classes)]
    rows = per_ensemble.withColumn("_w", winner(v))
    trees = sum(v[1:], v[0])
    sums = {
        "mmv": v,
        "emv": [F.when(F.col("_w") == k, 1.0).otherwise(0.0) for k in range(classes)],
        "memv": [F.when(F.col("_w") == k, margin(v) / trees).otherwise(0.0) for k in range(classes)],
    }
    out = rows.groupBy(*keep).agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(sums.get(rule, sums["emv"]))])
    if rule in ("pmv", "spmv"):
        n = [F.col(f"n{k}") for k in range(classes)]
        share = [F.when(x > 0, 1.0).otherwise(0.0) if rule == "pmv" else x / sum(n[1:], n[0]) for x in n]
        divisors = seen.agg(*[F.sum(x).alias(f"d{k}") for k, x in enumerate(share)])
        out = out.crossJoin(F.broadcast(divisors)).select(*keep, *[F.coalesce(F.try_divide(F.col(f"s{k}"), F.col(f"d{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(classes)])
    return out.withColumn("pred", winner([F.col(f"s{k}") for k in range(classes)]))


def oob_curve(v: DataFrame, in_bag: DataFrame, classes: int, row: str = "row_id") -> DataFrame:
    """tree, oob_rows, error: cumulative out-of-bag votes; the rows of a point are those out of the tree's own bag.

    v: row, label, tree, pred; in_bag: row, tree. Ties go to the lowest class.
    """
    out = v.join(in_bag, [row, "tree"], "left_anti")
    upto = Window.partitionBy(row).orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)
    counted = out.select(row, "label", "tree", *[F.sum(F.when(F.col("pred") == k, 1).otherwise(0)).over(upto).alias(f"v{k}") for k in range(classes)])
    wrong = winner([F.col(f"v{k}") for k in range(classes)]) != F.col("label")
    return counted.groupBy("tree").agg(F.count("*").alias("oob_rows"), (F.count_if(wrong) / F.count("*")).alias("error"))


def oob_trace(curve: DataFrame, slide: int = 5, build: int = 20) -> DataFrame:
    """tree, raw, mean, smooth, block_top, top of an out-of-bag curve (tree from 0, error; a row a tree): the accuracy, its
    mean so far, its mean over the last slide trees, that mean's largest value within the block of build trees so far, and so far in all."""
    order = Window.orderBy("tree")  # a row a tree
    rows = curve.select("tree", (1 - F.col("error")).alias("raw"), F.floor(F.col("tree") / build).alias("_block"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mean", F.avg("raw").over(upto)).withColumn("smooth", F.avg("raw").over(order.rowsBetween(1 - slide, 0)))
    within = Window.partitionBy("_block").orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("tree", "raw", "mean", "smooth", F.max("smooth").over(within).alias("block_top"), F.max("smooth").over(upto).alias("top"))


def stopping_point(curve: DataFrame, slide: int = 5, build: int = 20) -> DataFrame:
    """stop_tree, accuracy: the best raw accuracy in the block before the first block whose best sliding mean does not
    rise. curve: tree (from 0), error; a row a tree."""
    order = Window.orderBy("tree")
    rows = curve.select("tree", (1 - F.col("error")).alias("raw"), F.avg(1 - F.col("error")).over(order.rowsBetween(1 - slide, 0)).alias("smooth"), F.floor(F.col("tree") / build).alias("block"))
    blocks = rows.groupBy("block").agg(F.max("smooth").alias("top"), F.count("*").alias("n")).where(F.col("n") == build)
    blocks = blocks.withColumn("before", F.lag("top").over(Window.orderBy("block")))
    stop = blocks.where("top <= before").agg(F.min("block").alias("stop"))
    chosen = rows.crossJoin(F.broadcast(stop)).where("block = stop - 1")
    return chosen.orderBy(F.desc("raw"), "tree").limit(1).select(F.col("tree").alias("stop_tree"), F.col("raw").alias("accuracy"))
