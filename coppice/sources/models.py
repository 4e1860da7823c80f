"""Sinks and sources of results: trees as a table and as text, predictions, proximities, region files."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import scoring
from coppice.operators.scoring import Node

NODES = "tree int, id long, parent long, child int, attribute string, threshold double, label int, counts array<long>"


def node_table(spark: SparkSession, trees: list[Node]) -> DataFrame:
    """A row a node, in full precision."""
    rows = []

    for t, tree in enumerate(trees):
        todo: list[tuple[Node, int | None, int | None]] = [(tree, None, None)]
        while todo:
            node, parent, child = todo.pop()
            rows.append((t, node.id, parent, child, node.attribute, node.threshold, node.label, list(node.counts)))
            todo += [(c, node.id, i) for i, c in enumerate(node.children)]
    return spark.createDataFrame(rows, NODES)


def trees_of(nodes: DataFrame) -> list[Node]:
    """The trees of a node table: a model's rows, small by nature. Several models' tables make one ensemble by union."""
    by: dict[tuple[int, int | None], list] = {}
    for r in nodes.orderBy("tree", "parent", "child").collect():
        by.setdefault((r["tree"], r["parent"]), []).append(r)
    trees = []
    for tree in sorted(t for t, parent in by if parent is None):
        order = [by[tree, None][0]]
        for r in order:  # grows meanwhile
            order += by.get((tree, r["id"]), [])
        made: dict[int, Node] = {}
        for r in reversed(order):  # children come after their parents
            kids = tuple(made.pop(c["id"]) for c in by.get((tree, r["id"]), []))
            made[r["id"]] = Node(r["id"], r["attribute"], r["threshold"], kids, r["label"], tuple(r["counts"]))
        trees.append(made[order[0]["id"]])
    return trees


@dataclass(frozen=True)
class Ensemble:
    """Trees with what their text carries besides: a number for each class and attribute, the values that replace missing
    ones, and the weights of boosted trees."""

    trees: tuple[Node, ...]
    classes: int
    attributes: tuple[str, ...]
    discrete: dict[str, int] = field(default_factory=dict)
    imputed: tuple[str, ...] = ()
    betas: tuple[float, ...] = ()


def concatenated(ensembles: list[Ensemble]) -> Ensemble:
    """All trees as one ensemble; what else it carries is the first one's."""
    first = ensembles[0]
    if any((e.classes, e.attributes) != (first.classes, first.attributes) for e in ensembles):
        raise ValueError("ensembles of different classes or attributes")
    return replace(first, trees=tuple(t for e in ensembles for t in e.trees), betas=tuple(b for e in ensembles for b in e.betas))


def ensemble_text(e: Ensemble, class_counts: list[int] | None = None) -> str:
    """An ensemble as text: a header, then each tree in preorder, a line for each branch and leaf.

    Thresholds have six digits, as the format wants; the node table keeps all. A leaf without counts names its class alone."""
    number = {a: i for i, a in enumerate(e.attributes)}
    kinds = ["DISCRETE" if a in e.discrete else "CONTINUOUS" for a in e.attributes]
    out = [f"NumTrainingExamples  {sum(class_counts or [])}", f"NumClasses           {e.classes}", f"NumExamplesPerClass: {' '.join(map(str, class_counts or [0] * e.classes))} ", f"NumAttributes        {len(e.attributes)}", "NumSkippedAttributes 0", f"NumTrees             {len(e.trees)}", f"AttributeTypes: {' '.join(kinds)} ", f"SkipAttributes: {' '.join(['NOSKIP'] * len(kinds))} "]
    if e.imputed:
        out.append(f"MissingAttributeValues: {','.join(e.imputed)}")

    def visit(tree: Node) -> None:
        todo: list[Node | str] = [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.attribute is None:
                out.append(f"LEAF Class {node.label} Proportions {' '.join(map(str, node.counts))}" if node.counts else f"LEAF {node.label}")
            else:
                at = f"ATT# {number[node.attribute]}"
                for i, c in reversed(list(enumerate(node.children))):
                    todo += [c, f"SPLIT DISCRETE {at} VAL# {i + 1} / {len(node.children)}" if node.threshold is None else f"SPLIT CONTINUOUS {at} {'<' if i == 0 else '>='} {node.threshold:#6g}"]

    for i, t in enumerate(e.trees):
        out.append(f"Tree {i + 1}")
        if e.betas:
            out.append(f"Beta {e.betas[i]!r}")
        visit(t)
    return "\n".join(out) + "\n"


def ensemble_of(text: str, attributes: list[str] | None = None) -> Ensemble:
    """The ensemble of such a text, leaves of either style (with counts, or a class alone: probability 1).

    attributes: names by number, else Atr1... A text that ends within a tree, or a line that fits nowhere, raises."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    begin = next((i for i, x in enumerate(lines) if re.match(r"Tree \d+$", x)), len(lines))
    head = dict(re.match(r"(\w+):?\s*(.*)", x).groups() for x in lines[:begin])
    kinds = head.get("AttributeTypes", "").split()
    names = attributes or [f"Atr{i + 1}" for i in range(len(kinds))]
    discrete: dict[str, int] = {}
    trees: list[Node] = []
    betas: list[float] = []
    at = begin

    def read() -> Node:
        """A tree from the line at: branches that wait for children are on a stack."""
        nonlocal at
        ids, open_, done = itertools.count(1), [], None
        while True:
            if done is not None:
                if not open_:
                    return done
                open_[-1][4].append(done)
                done = None
            if open_ and len(open_[-1][4]) == open_[-1][3]:
                node, a, cut, n, kids, _ = open_.pop()
                if cut is None:
                    discrete[names[a]] = n
                done = Node(node, names[a], cut, tuple(kids))
                continue
            if open_:  # the line of the next branch
                _, a, cut, n, kids, heads = open_[-1]
                if at >= len(lines) or not lines[at].startswith(heads[len(kids)]) or (cut is None and lines[at] != heads[len(kids)]):
                    raise ValueError(f"a branch of attribute {a} is missing")
                at += 1
            if at >= len(lines):
                raise ValueError("the text ends within a tree")
            line, node = lines[at], next(ids)
            if m := re.match(r"LEAF Class (\d+) Proportions ([\d ]+)$", line):
                done = Node(node, label=int(m[1]), counts=tuple(int(x) for x in m[2].split()))
                at += 1
            elif m := re.match(r"LEAF (\d+)$", line):
                done = Node(node, label=int(m[1]))
                at += 1
            elif m := re.match(r"SPLIT CONTINUOUS ATT# (\d+) < (\S+)$", line):
                open_.append((node, int(m[1]), float(m[2]), 2, [], [f"SPLIT CONTINUOUS ATT# {m[1]} {sign} " for sign in ("<", ">=")]))
            elif m := re.match(r"SPLIT DISCRETE ATT# (\d+) VAL# 1 / (\d+)$", line):
                open_.append((node, int(m[1]), None, int(m[2]), [], [f"SPLIT DISCRETE ATT# {m[1]} VAL# {i + 1} / {m[2]}" for i in range(int(m[2]))]))
            else:
                raise ValueError(f"not a line of a tree: {line!r}")

    while at < len(lines):
        if not re.match(r"Tree \d+$", lines[at]):
            raise ValueError(f"not the beginning of a tree: {lines[at]!r}")
        at += 1
        if at < len(lines) and (m := re.match(r"Beta (\S+)$", lines[at])):
            betas.append(float(m[1]))
            at += 1
        trees.append(read())
    if "NumTrees" in head and int(head["NumTrees"]) != len(trees):
        raise ValueError(f"{head['NumTrees']} trees are announced, {len(trees)} found")
    imputed = tuple(head["MissingAttributeValues"].split(",")) if head.get("MissingAttributeValues") else ()
    return Ensemble(tuple(trees), int(head.get("NumClasses", 0)), tuple(names), discrete, imputed, tuple(betas))


def write_proximity(prox: DataFrame, path: str) -> None:
    """A proximity table (row, col, value) as comma-separated files, without a header."""
    prox.select("row", "col", "value").write.csv(path)


def read_proximity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, col long, value double").csv(path)


def write_predictions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Predictions as Parquet in a folder for each iteration and fold, or each timestep, as by says: what names of files would tell."""
    rows.write.partitionBy(*by).parquet(path)


def invalid(nodes: DataFrame, classes: int) -> DataFrame:
    """Nodes that break a tree: a missing parent, a branch without children, a leaf's class out of bounds."""
    up = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_up"))
    down = nodes.where("parent is not null").select("tree", F.col("parent").alias("id"), F.lit(True).alias("_down")).distinct()
    both = nodes.join(up, ["tree", "parent"], "left").join(down, ["tree", "id"], "left")
    orphan = F.col("parent").isNotNull() & F.col("_up").isNull()
    return both.where(orphan | (F.col("attribute").isNotNull() & F.col("_down").isNull()) | (F.col("attribute").isNull() & ~F.col("label").between(0, classes - 1))).select("tree", "id")


def predictions(tally: DataFrame, classes: list[str], weighted: bool = True) -> DataFrame:
    """Adds Pred (class name), Margin and Pr_<class> to rows with v0.. (votes) and p0.. (mean leaf probabilities)."""
    v = [F.col(f"v{k}") for k in range(len(classes))]
    share: list[Column] = [F.col(f"p{k}") if weighted else v[k] / sum(v[1:], v[0]) for k in range(len(classes))]
    rest = [c for c in tally.columns if c not in {f"{x}{k}" for x in "vp" for k in range(len(classes))}]
    names = F.array(*[F.lit(c) for c in classes])
    return tally.select(*rest, F.element_at(names, scoring.winner(share) + 1).alias("Pred"), scoring.margin(share).alias("Margin"), *[p.alias(f"Pr_{c}") for p, c in zip(share, classes, strict=True)])


def read_regions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """timestep, region, label, mesh, members of region files. A file is read whole by one task: its lines are a
    sequence; many files are many tasks."""
    text = spark.read.text(paths, wholetext=True).select("value")
    steps = text.select(F.explode(F.slice(F.split("value", r"(?m)^timestep "), 2, 1 << 30)).alias("s"))
    steps = steps.select(F.regexp_extract("s", r"^(\d+)", 1).cast("int").alias("timestep"), F.explode(F.slice(F.split("s", r"(?m)^region_number "), 2, 1 << 30)).alias("r"))
    number = lambda key: F.regexp_extract("r", rf"(?m)^{key} (-?\d+)", 1).cast("int")
    members = F.regexp_extract("r", r"(?m)^region_members *([-\d ]*)", 1)
    ints = F.transform(F.filter(F.split(members, " +"), lambda x: x != ""), lambda x: x.cast("long"))
    return steps.select("timestep", F.regexp_extract("r", r"^(\d+)", 1).cast("int").alias("region"), number("region_label").alias("label"), number("mesh_number").alias("mesh"), ints.alias("members"))


def region_lines(regions: DataFrame) -> DataFrame:
    """timestep, region, value: the text of each region, to be written by timestep (partitionBy) and read again."""
    head = F.concat(F.lit("timestep "), F.col("timestep"), F.lit("\nregion_number "), F.col("region"), F.lit("\nregion_label "), F.col("label"), F.lit("\nmesh_number "), F.col("mesh"))
    return regions.select("timestep", "region", F.concat(head, F.lit("\nregion_size "), F.size("members"), F.lit("\nregion_members "), F.array_join(F.col("members").cast("array<string>"), " "), F.lit("\n")).alias("value"))
