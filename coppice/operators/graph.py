"""Connected components of an edge table by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.plans.materialize import table


def closed(edges: DataFrame) -> bool:
    """Whether edges(u, v) are stars already: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up > 0 and down > 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the edges; component is the smallest node that can be reached.

    Alternates two steps until the edges are stars: each node's larger neighbours are linked to its smallest neighbour,
    then each node's smaller neighbours are. Edges never grow beyond their number, and a node's neighbours are only
    ever reduced to their minimum, so a hub's edges are not gathered. Empty edges give no rows. Raises if the
    components are not closed after ``rounds`` rounds (they need about the logarithm of the longest path).

    A round's edges are written as Parquet, once, and its small files are read by few tasks: what the driver keeps of
    stages and tasks is less than with checkpoints, which compute the last stage twice.
    """
    now = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "components")
    for done in range(rounds + 1):
        if closed(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        if done == rounds:
            break
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = now.union(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = turned.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = table(small, "components")
    raise RuntimeError(f"components did not close in {rounds} rounds")


def labelled(items: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of items(id, each once) along edges(u, v); an item without edges is its own."""
    found = components(edges, "u", "v").select(F.col("node").alias("id"), "component")
    return items.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def incident(incidence: DataFrame, element: str, node: str | list[str]) -> DataFrame:
    """Edges (u, v) of a bipartite table that join the elements of each node: each with the node's least one. As many edges
    as incidences, however many elements a node has."""
    node = [node] if isinstance(node, str) else node
    least = incidence.groupBy(*node).agg(F.min(element).alias("v"))
    return incidence.select(F.col(element).alias("u"), *node).join(least, node).select("u", "v").where("u != v").distinct()
