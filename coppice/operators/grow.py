"""Tree growth: large nodes of all trees level by level in one job a level, small ones whole, each in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scalars import MODULUS, draw, draw_for_filter
from coppice.operators import sampling, scoring, split
from coppice.operators.scoring import Flat, Node, matrix
from coppice.operators.subtree import Data, Rules, child_key, grown, root_key, stops
from coppice.plans.materialize import checkpoint, table

#: Bound of a model under growth: its nodes are on the driver and are sent to the tasks.
MOST_NODES = 1 << 22
#: Rows, and values, of a node that one task finishes.
SMALL_ROWS, SMALL_VALUES = 1 << 20, 1 << 23
#: Weight of any node, and how many rows there are for each different one where such rows are held as one.
MOST_ROWS, ALIKE = 1 << 62, 4


def grow(
    rows: DataFrame,
    row: str,
    attributes: list[str],
    classes: int,
    bags: DataFrame | None = None,
    trees: int = 1,
    criterion: str = "c45",
    depth: int | None = None,
    attributes_a_node: int | None = None,
    seed: int = 1,
    discrete: dict[str, int] | None = None,
    masks: dict[int, list[int]] | None = None,
    cuts: str = "best",
    fixed: int = 2,
    dynamic: bool = True,
    zero_gain: bool = False,
    collapse: bool = True,
    subsample: int = 0,
    small: int | None = None,
    folds: str | None = None,
    weights: str | None = None,
) -> list[Node]:
    """Trees on rows(row, label, attributes); bags(tree, row, weight), or weights, a column of arrays of rows' weights in each
    tree, or all rows once for each tree.

    Attributes are numbers; those of discrete (name: number of values) are codes from 0 and split into a branch a value,
    once on a path; no attribute is called tree, node, label or weight. cuts: best, extremely_random (one random cut an attribute, the best scored) or totally_random.
    attributes_a_node: how many attributes that can split, in random order, a node tries. masks: attributes (by number)
    that each tree may use. subsample: a node's split is chosen on so many of its rows. A node stops when it is pure, has
    fewer than twice the least branch, no split scores above 0 (with zero_gain: no split at all), or at depth.

    A null takes no part in its attribute's scan and goes with the values above a cut, or to the last branch; so does a
    code that isn't declared. Children that all say one class are merged; with collapse, a subtree that errs no less than
    its majority becomes a leaf. An empty branch says its parent's class.

    folds: a column of fold numbers; tree t grows on all rows but those of fold t, and there are no bags. Trees that so far
    have the same tests share their rows: a level counts a row once for each different region that it is in, by fold, and a
    tree's histogram is that of all folds less its own.

    Rows are held once, with an array of their weights in all trees. A level is a pass that finds the large nodes' rows (flat
    arrays in tasks), one histogram with partial sums before its shuffle and one scan; the sides of a cut are its children's
    counts. Nodes of at most small rows (SMALL_ROWS, fewer if there are many attributes) are then dealt to tasks whole, in one
    more pass. Where rows often have the label and attributes of others, such rows are held as one (see alike): then a level
    and its tasks have a row for each different one. Samples of nodes are drawn from the rows themselves, those of large nodes from
    the rows whose draws are small enough. Random choices depend on a node's place in its tree alone, so that both ways grow the same tree. Only nodes come
    to the driver: MOST_NODES at most, else it raises.
    """
    discrete = discrete or {}
    numbers = [i for i, a in enumerate(attributes) if a not in discrete]
    codes = [i for i, a in enumerate(attributes) if a in discrete]
    rules = Rules(len(attributes), classes, criterion, depth, attributes_a_node, seed, {attributes.index(a): n for a, n in discrete.items()}, masks, cuts, fixed, dynamic, zero_gain, subsample)
    if folds and (bags is not None or weights or subsample):
        raise ValueError("folds exclude bags and samples of nodes")
    if small is None:
        small = min(SMALL_ROWS, SMALL_VALUES // max(1, len(attributes)))
    data = held(rows, row, attributes, bags, trees, folds, weights)
    if subsample and bags is None and not weights:
        data = table(data, "growth")
    drawn, (data, different) = data, alike(data, row, attributes, trees, folds, bool(subsample or weights or bags is not None))
    if not subsample:
        drawn = data
        if different <= small:
            small = max(small, MOST_ROWS)  # nodes of any weight are few rows
    growing = [Growing(t) for t in range(trees)]
    keys, level = ["tree", "node", "place"], 0
    while any(t.open for t in growing):
        if sum(len(t.counts) for t in growing) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes")
        if any(t.counts[i] is None for t in growing for i in t.open):
            counted = [F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0)).alias(f"c{k}") for k in range(classes)]
            if folds:
                active, regions = in_regions(data, row, attributes, growing)
                own: dict[tuple[int, int], np.ndarray] = {}
                for r in active.groupBy("region", "fold").agg(*counted).collect():  # a row a region and fold
                    own[r["region"], r["fold"]] = np.array([r[f"c{k}"] for k in range(classes)])
                for i, of in enumerate(regions):
                    for t, node in of:
                        found = sum(c for (region, fold), c in own.items() if region == i and fold != t)
                        if not np.isscalar(found):
                            growing[t].counts[node] = tuple(int(x) for x in found)
            else:
                for r in placed(data, row, attributes, growing).groupBy("tree", "node").agg(*counted).collect():  # a row a node
                    growing[r["tree"]].counts[r["node"]] = tuple(int(r[f"c{k}"]) for k in range(classes))
        for t in growing:
            t.open = [i for i in t.open if t.counts[i] is not None and sum(t.counts[i]) and not stops(t.counts[i], classes, fixed, dynamic)] if level != depth else []
            t.ready += [(i, level) for i in t.open if sum(t.counts[i]) <= small]
            t.open = [i for i in t.open if sum(t.counts[i]) > small]
        if not any(t.open for t in growing):
            break
        at, regions = ["tree", "node", "place"], []
        if folds:
            at = ["region", "fold"]
            active, regions = in_regions(data, row, attributes, growing)
        elif subsample:
            active = node_samples(drawn, row, attributes, growing, subsample, seed + level)
        else:
            active = placed(data, row, attributes, growing)
        parts = F.array(*[F.struct(F.lit(i).alias("attribute"), F.col(c).alias("value")) for i, c in enumerate(attributes)])
        long = active.select(*at, "label", "weight", F.explode(parts).alias("x")).select(*at, "label", "weight", "x.*")
        if masks:
            allowed = rows.sparkSession.createDataFrame([(t, a) for t, own in masks.items() for a in own], "tree int, attribute int")
            long = long.join(F.broadcast(allowed), ["tree", "attribute"])  # trees x attributes at most
        hist = checkpoint(split.histogram(long, at, classes, weight=F.col("weight")))
        if folds:
            hist = complements(hist, regions, growing, classes)
        seeded = F.col("place") + F.col("attribute") * 1000003
        found = []
        sides = [f"l{k}" for k in range(classes)]
        if numbers:
            own = hist.where(F.col("attribute").isin(numbers))
            all_cuts = split.candidates(own, keys, classes, fixed, dynamic)
            share = draw(seeded, seed + 1) / F.lit(float(MODULUS))
            if cuts == "best":
                found.append(split.best_cuts(all_cuts, keys, classes, criterion).select(*keys, "attribute", "threshold", "score", *sides))
            elif cuts == "extremely_random":
                found.append(split.extremely_random_cuts(own, all_cuts, keys, classes, share))
            else:
                found.append(split.totally_random_cuts(all_cuts, keys, share, (draw(seeded, seed + 2) + 1) / F.lit(float(MODULUS))))
        if codes:
            own = hist.where(F.col("attribute").isin(codes))
            used = [(g.tree, i, a) for g in growing for i in g.open for a in g.used(i) if a in codes]
            if used:
                own = own.join(rows.sparkSession.createDataFrame(used, "tree int, node int, attribute int"), ["tree", "node", "attribute"], "left_anti")
            scores = split.discrete_splits(own, keys, classes, "gainratio" if cuts == "extremely_random" else criterion, fixed, dynamic)
            if cuts == "totally_random":
                scores = scores.withColumn("score", (draw(seeded, seed + 2) + 1) / F.lit(float(MODULUS)))
            found.append(scores)
        scored = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
        if attributes_a_node:
            order = Window.partitionBy(*keys).orderBy(draw(seeded, seed), "attribute")  # an attribute a row
            scored = scored.where("score is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= attributes_a_node).drop("_r")
        known = [c for c in sides if c in scored.columns] if not subsample else []
        chosen = split.best_attribute(scored, keys, zero_gain).select("tree", "node", "attribute", "threshold", *known).collect()
        for t in growing:
            t.open = []
        for r in sorted(chosen, key=lambda r: (r["tree"], r["node"])):
            t = growing[r["tree"]]
            t.divide(r["node"], r["attribute"], r["threshold"], 2 if r["threshold"] is not None else discrete[attributes[r["attribute"]]])
            if known and r["threshold"] is not None:  # nulls are with the values above the cut
                left = tuple(int(r[c]) for c in known)
                t.counts[-2:] = left, tuple(n - x for n, x in zip(t.counts[r["node"]], left, strict=True))
        level += 1
    finish(drawn, row, attributes, growing, rules, small, different if drawn is data else None)
    if sum(len(t.counts) for t in growing) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    return [t.finished(attributes, classes, collapse) for t in growing]


def finish(data: DataFrame, row: str, attributes: list[str], growing: list[Growing], rules: Rules, small: int, different: int | None = None) -> None:
    """Grows the subtrees of the ready nodes, each in a task, and hangs them on their trees. different: how many rows data has, if few."""
    known = {(t.tree, i): (t.key[i], frozenset(a for a in t.used(i) if a in rules.discrete), level) for t in growing for i, level in t.ready}
    if not known:
        return
    of = data.sparkSession.sparkContext.broadcast(known)
    n = sum(sum(t.counts[i]) for t in growing for i, _ in t.ready)
    n = n if different is None else min(n, different * len(growing))
    for t in growing:
        t.open, t.ready = [i for i, _ in t.ready], []

    def subtree(key: tuple, own: pa.Table) -> pa.Table:
        tree, node = (x.as_py() for x in key)
        place, used, level = of.value[tree, node]
        own = own.sort_by(row).combine_chunks()
        rows = own[row].to_numpy() if pa.types.is_integer(own.schema.field(row).type) else np.arange(own.num_rows)
        found = grown(Data(matrix([own[a] for a in attributes], own.num_rows), own["label"].to_numpy(), own["weight"].to_numpy(), rows), tree, place, used, level, rules)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "attribute": pa.array([found.attribute], pa.list_(pa.int32())), "threshold": pa.array([found.threshold], pa.list_(pa.float64())), "first": pa.array([found.first], pa.list_(pa.int32())), "children": pa.array([found.children], pa.list_(pa.int32())), "counts": pa.array([found.counts], pa.list_(pa.int64()))})

    # a number of its own isn't coalesced: a group is much work on little data
    partitions = max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(8 * len(known), 256), n // (4 * small))
    active = placed(data, row, attributes, growing).select("tree", "node", "weight", row, "label", *attributes).repartition(partitions, "tree", "node")
    out = active.groupBy("tree", "node").applyInArrow(subtree, "tree int, node int, attribute array<int>, threshold array<double>, first array<int>, children array<int>, counts array<long>").toArrow()
    for r in sorted(out.to_pylist(), key=lambda r: (r["tree"], r["node"])):
        growing[r["tree"]].hang(r["node"], r["attribute"], r["threshold"], r["first"], r["children"], r["counts"], rules.classes)


def held(rows: DataFrame, row: str, attributes: list[str], bags: DataFrame | None, trees: int, folds: str | None = None, weights: str | None = None) -> DataFrame:
    """row, label, attributes, weights (of each tree), with folds _fold and _n (1); rows in no bag are left out. Bags are joined
    and the rows written."""
    own = [F.col(folds).cast("int").alias("_fold"), F.lit(1).cast("long").alias("_n")] if folds else []
    own += [F.col(weights).alias("weights")] if weights else []
    data = rows.where("label is not null").select(row, F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in attributes], *own)
    if weights:
        return data.where(F.array_max("weights") > 0)
    if folds:
        return data.withColumn("weights", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.when(t == F.col("_fold"), 0).otherwise(1)))
    if bags is None:
        return data.withColumn("weights", F.array_repeat(F.lit(1), trees))
    each = bags.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col("tree").cast("int"), F.col("weight").cast("int")))).alias("_w"))
    of = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("_w", t), F.lit(0)))
    return table(data.join(each, row).withColumn("weights", of).drop("_w"), "growth")


def alike(data: DataFrame, row: str, attributes: list[str], trees: int, folds: str | None = None, kept: bool = False) -> tuple[DataFrame, int]:
    """Rows of one label, the same attributes and fold as one with the sums of their weights and the least row, and how many
    they are, where rows are ALIKE or more times as many, by an estimate; else data (written, unless it is kept already) and its rows."""
    same = ["label", *attributes, *(["_fold"] if folds else [])]
    n, different = data.agg(F.count("*"), F.approx_count_distinct(F.struct(*same))).first()
    if different * ALIKE > n:
        return data if kept else table(data, "growth"), n
    sums = [F.array(*[F.sum(F.col("weights")[t].cast("long")) for t in range(trees)]).alias("weights"), *([F.sum("_n").alias("_n")] if folds else [])]
    found = table(data.groupBy(*same).agg(F.min(row).alias(row), *sums), "growth-alike")
    return found, found.count()


def node_samples(data: DataFrame, row: str, attributes: list[str], growing: list[Growing], n: int, seed: int) -> DataFrame:
    """placed(data), of each open node the n rows (or all) of the least draws.

    Rows whose draws are above a bound go no further. It leaves the smallest node some times n rows; if a node has fewer
    than n after all, it is raised until it leaves all rows."""
    least = min(sum(t.counts[i]) for t in growing for i in t.open)
    bound = min(1.0, (4 * n + 64) / least)
    while True:
        some = data if bound >= 1 else data.where(draw_for_filter(F.col(row), seed) < int(bound * MODULUS))
        some = placed(some, row, attributes, growing).withColumn("_unit", F.col("tree").cast("long") * (1 << 32) + F.col("node"))
        if bound < 1:
            some = table(some, "node-samples")
            sizes = some.groupBy("_unit").count()
            enough = sizes.where(F.col("count") >= n).count()  # a row an open node
            if enough < sum(len(t.open) for t in growing):
                bound *= 8
                continue
        return sampling.node_sample(some, row, "_unit", n, seed).drop("_unit")


class Growing:
    """A tree under growth: of each node its parent, key, counts and split."""

    def __init__(self, tree: int) -> None:
        self.tree = tree
        self.parent: list[int | None] = []
        self.key: list[int] = []
        self.counts: list[tuple[int, ...] | None] = []
        self.split: list[tuple[int, float | None, int, int] | None] = []  # attribute, threshold, first child, children
        self.open: list[int] = []
        self.ready: list[tuple[int, int]] = []  # small nodes and their levels
        self.add(None, root_key(tree))

    def add(self, parent: int | None, key: int) -> None:
        self.open.append(len(self.parent))
        self.parent.append(parent)
        self.key.append(key)
        self.counts.append(None)
        self.split.append(None)

    def divide(self, node: int, attribute: int, threshold: float | None, children: int) -> None:
        self.split[node] = attribute, threshold, len(self.parent), children
        for i in range(children):
            self.add(node, child_key(self.key[node], i))

    def hang(self, node: int, attribute: list[int], threshold: list[float | None], first: list[int], children: list[int], counts: list[int], classes: int) -> None:
        """Puts a subtree in place of a node; its own nodes but the first are added in order."""
        base = len(self.parent) - 1
        place = lambda i: base + i if i else node
        self.parent += [None] * (len(attribute) - 1)
        self.counts += [tuple(counts[i * classes : (i + 1) * classes]) for i in range(1, len(attribute))]
        self.split += [None] * (len(attribute) - 1)
        for i, a in enumerate(attribute):
            if a >= 0:
                self.split[place(i)] = a, threshold[i], place(first[i]), children[i]
                for k in range(first[i], first[i] + children[i]):
                    self.parent[place(k)] = place(i)

    def path(self, node: int) -> tuple:
        """The tests above a node and their outcomes."""
        out = []
        while (up := self.parent[node]) is not None:
            attribute, threshold, first, _ = self.split[up]
            out.append((attribute, threshold, node - first))
            node = up
        return tuple(out)

    def used(self, node: int) -> set[int]:
        out = set()
        while (node := self.parent[node]) is not None:
            out.add(self.split[node][0])
        return out

    def flat(self) -> Flat:
        splits = [s or (-1, None, 0, 0) for s in self.split]
        return Flat(np.array([s[0] for s in splits], np.int64), np.array([np.nan if s[1] is None else s[1] for s in splits]), np.array([s[2] for s in splits], np.int64), np.array([s[3] for s in splits], np.int64))

    def finished(self, attributes: list[str], classes: int, collapse: bool) -> Node:
        out: dict[int, Node] = {}
        wrong: dict[int, int] = {}
        full: list[tuple[int, ...]] = []  # counts; those of an empty branch are its parent's
        for i, counts in enumerate(self.counts):  # parents come before their children
            up = self.parent[i]
            full.append(counts if counts is not None and sum(counts) else (0,) * classes if up is None else full[up])
        for i in reversed(range(len(self.parent))):
            counts = full[i]
            seen = self.counts[i] is not None and sum(self.counts[i]) > 0
            leaf = Node(i + 1, label=counts.index(max(counts)), counts=counts, seen=seen)
            own = sum(counts) - max(counts) if seen else 0
            if self.split[i] is None:
                out[i], wrong[i] = leaf, own
                continue
            attribute, threshold, first, n = self.split[i]
            kids = tuple(out.pop(first + k) for k in range(n))
            below = sum(wrong.pop(first + k) for k in range(n))
            alike = all(k.attribute is None and k.label == leaf.label for k in kids)
            if alike or (collapse and below >= own):
                out[i], wrong[i] = leaf, own
            else:
                out[i], wrong[i] = Node(i + 1, attributes[attribute], threshold, kids, leaf.label, counts), below
        return out[0]


def placed(data: DataFrame, row: str, attributes: list[str], growing: list[Growing]) -> DataFrame:
    """tree, node, place (the node's key), weight, row, label, attributes: the open node of each row in each tree whose bag has it."""
    flats = data.sparkSession.sparkContext.broadcast([t.flat() for t in growing])
    ready = data.sparkSession.sparkContext.broadcast([(np.array(sorted(t.open), np.int64), np.array([t.key[i] for i in sorted(t.open)], np.int64)) for t in growing])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix([batch.column(2 + i) for i in range(len(attributes))], batch.num_rows)
            nodes = np.full((batch.num_rows, len(flats.value)), -1, np.int32)
            places = np.zeros(nodes.shape, np.int64)
            for t, (flat, (opened, keys)) in enumerate(zip(flats.value, ready.value, strict=True)):
                if len(opened):
                    at = flat.walk(values)
                    found = np.minimum(np.searchsorted(opened, at), len(opened) - 1)
                    nodes[:, t] = np.where(opened[found] == at, at, -1)
                    places[:, t] = keys[found]
            offsets = pa.array(np.arange(0, nodes.size + 1, max(1, nodes.shape[1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))) for x in (nodes, places)]], [*batch.schema.names, "nodes", "places"])

    plain = data.select(row, "label", *attributes, "weights")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    found = plain.mapInArrow(route, f"{kinds}, nodes array<int>, places array<long>")
    found = found.select(row, "label", *attributes, F.posexplode(F.arrays_zip("nodes", "places", "weights")).alias("tree", "_at"))
    return found.select("tree", F.col("_at.nodes").alias("node"), F.col("_at.places").alias("place"), F.col("_at.weights").alias("weight"), row, "label", *attributes).where("node >= 0 and weight > 0")


def in_regions(data: DataFrame, row: str, attributes: list[str], growing: list[Growing]) -> tuple[DataFrame, list[list[tuple[int, int]]]]:
    """region, fold, weight, row, label, attributes: each row once for each region of open nodes that it is in, in a tree that
    it may be in; and the nodes (tree, node) of each region. Nodes of different trees are one region if the tests above them are the same."""
    number: dict[tuple, int] = {}
    regions: list[list[tuple[int, int]]] = []
    for t in growing:
        for i in t.open:
            key = t.path(i)
            if key not in number:
                number[key] = len(regions)
                regions.append([])
            regions[number[key]].append((t.tree, i))
    flats = data.sparkSession.sparkContext.broadcast([t.flat() for t in growing])
    ready = data.sparkSession.sparkContext.broadcast([(np.array(sorted(t.open), np.int64), np.array([number[t.path(i)] for i in sorted(t.open)], np.int32)) for t in growing])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix([batch.column(2 + i) for i in range(len(attributes))], batch.num_rows)
            fold = batch.column(2 + len(attributes)).to_numpy()
            found = np.full((batch.num_rows, len(flats.value)), -1, np.int32)
            for t, (flat, (opened, region)) in enumerate(zip(flats.value, ready.value, strict=True)):
                if len(opened):
                    at = flat.walk(values)
                    near = np.minimum(np.searchsorted(opened, at), len(opened) - 1)
                    found[:, t] = np.where((opened[near] == at) & (fold != t), region[near], -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1  # each region once
            offsets = pa.array(np.arange(0, found.size + 1, max(1, found.shape[1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))], [*batch.schema.names, "regions"])

    plain = data.select(row, "label", *attributes, F.col("_fold").alias("fold"), F.col("_n").alias("weight"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    placed = plain.mapInArrow(route, f"{kinds}, regions array<int>").withColumn("region", F.explode("regions")).where("region >= 0")
    return placed.select("region", "fold", "weight", row, "label", *attributes), regions


def complements(hist: DataFrame, regions: list[list[tuple[int, int]]], growing: list[Growing], classes: int) -> DataFrame:
    """tree, node, place, attribute, value, c0..: of a histogram by region and fold, each tree's: all folds less its own."""
    nodes = hist.sparkSession.createDataFrame([(i, t, n, growing[t].key[n]) for i, of in enumerate(regions) for t, n in of], "region int, tree int, node int, place long")
    counts = [f"c{k}" for k in range(classes)]
    each = hist.groupBy("region", "attribute", "value").agg(*[F.sum(c).alias(c) for c in counts], F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*counts).alias("n")))).alias("own"))  # an entry a fold
    both = each.join(F.broadcast(nodes), "region")  # a row an open node
    own = F.try_element_at("own", F.col("tree"))
    left = both.select("tree", "node", "place", "attribute", "value", *[(F.col(c) - F.coalesce(own[c], F.lit(0))).alias(c) for c in counts])
    return left.where(split.total([F.col(c) for c in counts]) > 0)


def errors(node: Node) -> int:
    """Training rows that a subtree gets wrong; an empty branch has none."""
    return sum(sum(n.counts) - max(n.counts) for n in scoring.nodes_of(node) if n.attribute is None and n.seen and n.counts)


def to_dot(tree: Node, classes: list[str] | None = None) -> str:
    """A tree as a Graphviz digraph."""
    out = ["digraph tree {"]
    for node in scoring.nodes_of(tree):
        name = str(node.label) if classes is None else classes[node.label]
        label = f"class {name}" if node.attribute is None else node.attribute if node.threshold is None else f"{node.attribute} < {node.threshold:g}"
        out.append(f'  n{node.id} [label="{label}"];')
        edges = ("yes", "no") if node.threshold is not None else [str(i) for i in range(len(node.children))]
        out += [f'  n{node.id} -> n{c.id} [label="{edge}"];' for c, edge in zip(node.children, edges, strict=True)]
    return "\n".join([*out, "}"]) + "\n"
