"""Set algebra of regions: rows (timestep, region, label, mesh, members)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators import graph, sampling
from coppice.plans.materialize import checkpoint, table


#: Points that a task compares, about.
TASK_POINTS = 1 << 18


def points(regions: DataFrame, name: str) -> DataFrame:
    return regions.select("timestep", "mesh", F.col("label").alias(name), F.explode("members").alias("member"))


def compare(truth: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """timestep, mesh, label, members of truth inside ('left_semi') or outside ('left_anti') all regions found."""
    inside = points(found, "other").select("timestep", "mesh", "member").distinct()
    kept = points(truth, "label").join(inside, ["timestep", "mesh", "member"], how)
    return kept.groupBy("timestep", "mesh", "label").agg(F.count("*").alias("members"), F.min("member").alias("first_member"), F.max("member").alias("last_member"))


def overlap(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth_label, found_label, n: members in common over all timesteps, whatever the mesh."""
    a = points(truth, "truth_label").select("timestep", "truth_label", "member")
    b = points(found, "found_label").select("timestep", "found_label", "member")
    return a.join(b, ["timestep", "member"]).groupBy("truth_label", "found_label").agg(F.count("*").alias("n"))


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """timestep, mesh, label, members: the members of a label's regions in either of two tables, sorted, each once."""
    both = points(a, "label").unionByName(points(b, "label")).distinct()
    return both.groupBy("timestep", "mesh", "label").agg(F.sort_array(F.collect_list("member")).alias("members"))


def deduplicated(regions: DataFrame) -> DataFrame:
    """Regions whose members are sorted and occur once."""
    return regions.withColumn("members", F.array_sort(F.array_distinct("members")))


def by_label(regions: DataFrame) -> DataFrame:
    """timestep, label, regions (their numbers, sorted), size and largest number of each label."""
    sizes = F.sum(F.size("members")).alias("size")
    return regions.groupBy("timestep", "label").agg(F.sort_array(F.collect_set("region")).alias("regions"), sizes, F.max("region").alias("largest"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a or b), timestep, mesh, label, member of what only one of two tables of regions holds; none if they are equal."""
    key = ["timestep", "mesh", "label", "member"]
    n = sum(x.agg(F.sum(F.size("members"))).first()[0] or 0 for x in (a, b))
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_POINTS)
    both = points(a, "label").withColumn("_a", F.lit(1)).unionByName(points(b, "label").withColumn("_a", F.lit(0)))
    # dealt before they are counted: a task that reads a few long regions holds no table of all their points
    both = both.repartition(parts, *key).groupBy(*key).agg(F.max("_a").alias("_a"), F.min("_a").alias("_b"))
    return both.where("_a = _b").select(F.when(F.col("_a") == 1, "a").otherwise("b").alias("side"), *key)


def segmentation(truth: DataFrame, found: DataFrame, percent: int = 50) -> DataFrame:
    """timestep, kind, truth_labels, found_labels: how the found regions of each timestep that both have meet the true ones.

    A pair is correct if its common members are percent of either label's; over: a truth of several found labels that
    each lie in it by percent and together fill percent of it; under: likewise a found label of several truths. A truth
    in no such row is missed, a found label is noise."""
    a, b = points(truth, "t").select("timestep", "t", "member").distinct(), points(found, "f").select("timestep", "f", "member").distinct()
    steps = a.select("timestep").distinct().intersect(b.select("timestep").distinct())
    a, b = a.join(steps, "timestep"), b.join(steps, "timestep")
    tn, fn = a.groupBy("timestep", "t").agg(F.count("*").alias("tn")), b.groupBy("timestep", "f").agg(F.count("*").alias("fn"))
    pairs = a.join(b, ["timestep", "member"]).groupBy("timestep", "t", "f").agg(F.count("*").alias("n")).join(tn, ["timestep", "t"]).join(fn, ["timestep", "f"])
    pairs = checkpoint(pairs.withColumns({"big_t": F.col("n") * 100 >= F.col("tn") * percent, "big_f": F.col("n") * 100 >= F.col("fn") * percent}))
    one = lambda c: F.array(F.col(c))
    correct = pairs.where("big_t and big_f").select("timestep", F.lit("correct").alias("kind"), one("t").alias("truth_labels"), one("f").alias("found_labels"))

    def several(inside: str, whole: str, size: str, part: str, kind: str) -> DataFrame:
        rows = pairs.where(inside).groupBy("timestep", whole).agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.first(size).alias("size"), F.sort_array(F.collect_list(part)).alias("list"))
        rows = rows.where((F.col("parts") > 1) & (F.col("n") * 100 >= F.col("size") * percent))
        t, f = (one(whole), F.col("list")) if whole == "t" else (F.col("list"), one(whole))
        return rows.select("timestep", F.lit(kind).alias("kind"), t.alias("truth_labels"), f.alias("found_labels"))

    classed = checkpoint(correct.unionByName(several("big_f", "t", "tn", "f", "over")).unionByName(several("big_t", "f", "fn", "t", "under")))
    none = F.array().cast("array<long>")
    missed = tn.join(classed.select("timestep", F.explode("truth_labels").alias("t")).distinct(), ["timestep", "t"], "left_anti").select("timestep", F.lit("missed").alias("kind"), one("t").alias("truth_labels"), none.alias("found_labels"))
    noise = fn.join(classed.select("timestep", F.explode("found_labels").alias("f")).distinct(), ["timestep", "f"], "left_anti").select("timestep", F.lit("noise").alias("kind"), none.alias("truth_labels"), one("f").alias("found_labels"))
    return classed.unionByName(missed).unionByName(noise)


def as_variable(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """nodes(timestep, mesh, node, ...) with label: that of the region (the least of several) that holds the node, else 0."""
    at = points(regions, "label").groupBy("timestep", "mesh", F.col("member").alias("node")).agg(F.min("label").alias("label"))
    return nodes.join(at, ["timestep", "mesh", "node"], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))


def displacements(columns: list[str]) -> tuple[str, str, str] | None:
    """The columns that hold a mesh's displacement, by the names they usually have; None without all three."""
    for stem in ("DISPL", "displ_", "DIS"):
        by = {c.upper(): c for c in columns}
        found = [by.get(f"{stem}{x}".upper()) for x in "XYZ"]
        if all(found):
            return tuple(found)
    return None


def near_pairs(a: DataFrame, b: DataFrame, axes: list[str], radius: float, same: list[str]) -> DataFrame:
    """Rows of a and b, as structs, that agree in the columns same and lie within radius: a join on cells of that size; each
    row of b is sent to the cells around its own. Both sides are shuffled: Spark guesses b's size without its copies."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    left = a.select(F.struct("*").alias("a"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(same)], *[cell(c).alias(f"_c{i}") for i, c in enumerate(axes)])
    right = b.select(F.struct("*").alias("b"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(same)], *[cell(c).alias(f"_c{i}") for i, c in enumerate(axes)])
    for i in range(len(axes)):
        right = right.withColumn(f"_c{i}", F.explode(F.sequence(F.col(f"_c{i}") - 1, F.col(f"_c{i}") + 1)))
    both = left.join(right.hint("merge"), [*[f"_s{i}" for i in range(len(same))], *[f"_c{i}" for i in range(len(axes))]])
    square = sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2.0) for c in axes), F.lit(0.0))
    return both.where(square <= radius * radius).select("a", "b")


def smoothed(nodes: DataFrame, value: str, radius: float, axes: tuple[str, ...] = ("x", "y", "z"), local: bool = True) -> DataFrame:
    """timestep, mesh, node, value: the mean over all nodes (with local: of the same mesh) within the radius, itself too.

    Nodes at one place are one: pairs are those of places, however many nodes a place has."""
    same = ["timestep", "mesh"] if local else ["timestep"]
    at = [*same, *axes]
    places = table(nodes.groupBy(*at).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n")), "smoothing-places")
    both = near_pairs(places.select(*at), places, list(axes), radius, same)
    means = both.groupBy(*[F.col(f"a.{c}").alias(c) for c in at]).agg(F.try_divide(F.sum("b._sum"), F.sum("b._n")).alias(value))
    return nodes.select("timestep", "mesh", "node", *axes).join(means.hint("merge"), at).select("timestep", "mesh", "node", value)


def longest_edge(edges: DataFrame, nodes: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """mesh, length of the longest of edges(mesh, u, v) between nodes(mesh, node, axes): the separation below which regions join by default."""
    end = lambda c: nodes.select("mesh", F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in axes])
    both = edges.join(end("u"), ["mesh", "u"]).join(end("v"), ["mesh", "v"])
    square = sum((F.pow(F.col(f"u_{x}") - F.col(f"v_{x}"), 2.0) for x in axes), F.lit(0.0))
    return both.groupBy("mesh").agg(F.sqrt(F.max(square)).alias("length"))


def joined_near(cells: DataFrame, separation: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """cells(timestep, component, axes) with label: components of one timestep with cells within the separation get one
    label, and so do those that are joined through others; labels count from 0 in a timestep by the least component."""
    both = near_pairs(cells.select("timestep", "component", *axes), cells.select("timestep", "component", *axes), list(axes), separation, ["timestep"])
    # a component's number may occur in several timesteps: both together tell it apart
    named = lambda x: F.struct(F.col(f"{x}.timestep").alias("timestep"), F.col(f"{x}.component").alias("component"))
    edges = both.select(named("a").alias("u"), named("b").alias("v")).where("u != v").distinct()
    regions = cells.alias("c").select(named("c").alias("id")).distinct()
    roots = graph.labelled(regions, edges).select("id.timestep", F.col("id.component").alias("component"), F.col("component").alias("root"))
    ranks = roots.select("timestep", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("timestep").orderBy("root")) - 1)  # a row a joined region
    return cells.join(roots.join(ranks, ["timestep", "root"]).drop("root"), ["timestep", "component"])


def border_nodes(nodes: DataFrame) -> DataFrame:
    """node, parts of the nodes that more than one part holds."""
    return nodes.groupBy("node").agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def connected(cells: DataFrame) -> DataFrame:
    """timestep, x, y, component of active grid cells joined by edges; component is the least cell number. Cells need id,
    timestep, x, y."""
    a, b = cells.alias("a"), cells.alias("b")
    same = F.col("a.timestep") == F.col("b.timestep")
    ends = [F.col("a.id").alias("u"), F.col("b.id").alias("v")]
    edges = a.join(b, same & (F.col("a.x") + 1 == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))).select(*ends)
    edges = edges.union(a.join(b, same & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") + 1 == F.col("b.y"))).select(*ends))
    found = graph.labelled(cells, edges)
    return cells.join(found, "id").select("timestep", "x", "y", "component")


def mesh_segments(incidence: DataFrame, values: DataFrame, operator: str, threshold: float) -> DataFrame:
    """timestep, mesh, element, segment (from 0 in a timestep and mesh, by the least element) of the elements whose value
    passes the threshold; elements that share a node are in one segment, and so are those that are joined through others.

    incidence(timestep, mesh, element, node): the nodes of each element, any number, of any kind of element. values(timestep,
    mesh, element, value). operator: one of > >= < <= = !=. An element without nodes is a segment by itself."""
    passes = {">": F.col("value") > threshold, ">=": F.col("value") >= threshold, "<": F.col("value") < threshold, "<=": F.col("value") <= threshold, "=": F.col("value") == threshold, "!=": F.col("value") != threshold}
    if operator not in passes:
        raise ValueError(f"the operator is one of {' '.join(passes)}")
    own = ["timestep", "mesh", "element"]
    # elements are numbered in their order: numbers are compared, hashed and sent at less cost than their three columns
    active = table(sampling.numbered(values.where(passes[operator]).select(*own).distinct(), own, "id"), "mesh-elements")
    least = incidence.join(active, own).select("timestep", "mesh", "node", "id")
    edges = graph.incident(least, "id", ["timestep", "mesh", "node"])
    found = active.join(graph.labelled(active, edges), "id")
    first = found.select("timestep", "mesh", "component").distinct()
    numbered = first.withColumn("segment", (F.row_number().over(Window.partitionBy("timestep", "mesh").orderBy("component")) - 1).cast("int"))  # a row a segment
    return found.join(numbered, ["timestep", "mesh", "component"]).select(*own, "segment")
