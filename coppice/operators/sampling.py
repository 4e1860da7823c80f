"""Bags, folds, clumps, neighbours, synthetic rows, boosting weights."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scalars import MODULUS, draw, wide_draw
from coppice.operators.prefix import ROW_BITS, ordered, running
from coppice.plans.materialize import checkpoint, table


def numbered(df: DataFrame, key: str | list[str], out: str = "at") -> DataFrame:
    """Gapless numbers from 0 by a key: rows are written along it once, and a task's are numbered after those of the tasks before."""
    rows = ordered(df, [key] if isinstance(key, str) else key)
    tasks = rows.groupBy("_task").agg(F.count("*").alias("_n"))
    first = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_first"))  # a row a task
    at = F.col("_first") + F.col("_pos") - F.shiftleft("_task", ROW_BITS)
    return rows.join(F.broadcast(first), "_task").select(*df.columns, at.alias(out))


def shuffled_places(rows: DataFrame, key: str, label: str, seed: int = 1, parts: int = 1024) -> DataFrame:
    """Adds at: a row's place from 0 in its class's shuffled order. Ranges of the draw are numbered separately, so that
    no class meets in one task. Rows without a class take no part."""
    drawn, part, n, before, place = "_place_draw", "_place_part", "_place_n", "_place_before", "_place_at"
    # draws are never null, and said so: else a join filters by the whole formula once more, too long to be compiled
    rows = rows.where(F.col(key).isNotNull()).withColumn(drawn, F.coalesce(draw(F.col(key), seed), F.lit(0))).withColumn(part, F.coalesce(F.floor(F.col(drawn) * parts / MODULUS), F.lit(0)))
    sizes = rows.groupBy(label, part).agg(F.count("*").alias(n))
    sizes = sizes.select(label, part, (F.sum(n).over(Window.partitionBy(label).orderBy(part)) - F.col(n)).alias(before))
    at = F.row_number().over(Window.partitionBy(label, part).orderBy(drawn, key)) - 1
    return rows.withColumn(place, at).join(sizes, [label, part]).withColumn("at", F.col(before) + F.col(place)).drop(drawn, part, place, before)


#: Rows of a range whose bag counts are drawn at once are 2 ** BAG_BITS.
BAG_BITS = 12


def range_counts(n: int, draws: int, seed: int, tree: int, at: int, bits: int = BAG_BITS) -> np.ndarray:
    """How often each row of range number at (of n rows, 2 ** bits a range) is among a tree's draws with replacement.

    The draws go down a tree of ranges: of those of a range, a binomial number by the rows is in its left half. A range's
    generator is that of its place in this tree, so that any task finds the same counts without the others: together the
    counts are exactly multinomial, at any n and number of draws."""
    low, high = 0, max(1, -(-n >> bits))
    rows = lambda a, z: min(n, z << bits) - (a << bits)
    generator = lambda: np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, tree], counter=[low, high, 0, 0]))
    while high - low > 1 and draws:
        middle = (low + high) // 2
        left = int(generator().binomial(draws, rows(low, middle) / rows(low, high)))
        low, high, draws = (low, middle, left) if at < middle else (middle, high, draws - left)
    return np.bincount(generator().integers(0, rows(at, at + 1), draws), minlength=rows(at, at + 1)) if draws else np.zeros(rows(at, at + 1), np.int64)


def weighed(at: np.ndarray, n: int, draws: int, trees: int, seed: int) -> np.ndarray:
    """How often each of the rows numbered at is among each tree's draws. See range_counts."""
    out = np.zeros((len(at), trees), np.int64)
    for r in np.unique(at >> BAG_BITS):
        own = np.flatnonzero(at >> BAG_BITS == r)
        for t in range(trees):
            out[own, t] = range_counts(n, draws, seed, t, int(r))[at[own] & ((1 << BAG_BITS) - 1)]
    return out


def shared(weights: np.ndarray | list[int], draws: int, seed: int, of: int = 0) -> np.ndarray:
    """How often each of some integer weights is among draws with replacement in proportion to them: exactly multinomial. of:
    which of several such draws of a seed it is."""
    weights = np.asarray(weights, np.int64)
    out = np.zeros(len(weights), np.int64)
    some = np.flatnonzero(weights > 0)
    if draws and len(some):
        p = weights[some].astype(np.float64)
        out[some] = np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, of])).multinomial(draws, p / p.sum())
    return out


def bag_weights(rows: DataFrame, n: int, trees: int, percent: int = 100, seed: int = 1, out: str = "weights") -> DataFrame:
    """rows(at, others) with an array of their weights in the bags of bag: a map over the rows, which stay where they are."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = weighed(batch.column("at").to_numpy(), n, n * percent // 100, trees, seed)
            offsets = pa.array(np.arange(0, found.size + 1, trees, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1).astype(np.int32)))], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(weigh, f"{kinds}, `{out}` array<int>")


def bag(rows: DataFrame, key: str, n: int, trees: int, percent: int = 100, seed: int = 1) -> DataFrame:
    """tree, key, weight: how often each of n numbered rows (at) is drawn with replacement in n * percent / 100 draws a tree.

    A map over the rows: nothing is shuffled, no draw is a row. See range_counts."""
    draws = n * percent // 100

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, weight in enumerate(weighed(batch.column(0).to_numpy(), n, draws, trees, seed).T):
                took = np.flatnonzero(weight)
                if len(took):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(took), t, np.int32)), batch.column(1).take(pa.array(took)), pa.array(weight[took])], ["tree", key, "weight"])

    # ranges whole in a task, or nearly: numbered rows come sorted within partitions, but need not
    return rows.select(F.col("at").cast("long"), key).mapInArrow(weigh, f"tree int, `{key}` {rows.schema[key].dataType.simpleString()}, weight long")


def drawn_bag(rows: DataFrame, key: str, n: int, trees: int, percent: int = 100, seed: int = 1) -> DataFrame:
    """The same law from a table of portable draws, which any engine can make: for checks against SQL, as it shuffles a row a draw."""
    spark, size = rows.sparkSession, n * percent // 100
    draws = spark.range(trees * size).select(F.floor(F.col("id") / size).cast("int").alias("tree"), (wide_draw(F.col("id"), seed) % n).alias("at"))
    return draws.groupBy("tree", "at").agg(F.count("*").alias("weight")).join(rows.select("at", key), "at").select("tree", key, "weight")


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int = 1) -> DataFrame:
    """fold of each row: shuffled, sorted by class, then dealt in turn over the whole order."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    counts = counts.select(label, (F.sum("_n").over(Window.orderBy(label)) - F.col("_n")).alias("_before"))
    placed = shuffled_places(rows, key, label, seed).join(F.broadcast(counts), label)  # a row a class
    return placed.withColumn("fold", ((F.col("_before") + F.col("at")) % folds).cast("int")).drop("at", "_before")


def majority_bag(rows: DataFrame, key: str, label: str, quotas: dict[int, int], trees: int, seed: int = 1) -> DataFrame:
    """tree, key, weight: each row of a class without a quota once; of the others quota draws with replacement."""
    placed = shuffled_places(rows.select(key, label), key, label, seed)
    sizes = placed.groupBy(label).agg(F.count("*").alias("_n"))
    total = sum(quotas.values())
    slot, of, upto = F.col("id") % total, F.lit(None).cast("int"), total
    for k, q in sorted(quotas.items(), reverse=True):
        upto -= q
        of = F.coalesce(of, F.when(slot >= upto, F.lit(k)))
    draws = rows.sparkSession.range(trees * total).select(F.floor(F.col("id") / total).cast("int").alias("tree"), of.alias(label), wide_draw(F.col("id"), seed + 1).alias("_d"))
    draws = draws.join(F.broadcast(sizes), label).withColumn("at", F.col("_d") % F.col("_n"))  # a row a class
    drawn = draws.groupBy("tree", label, "at").agg(F.count("*").alias("weight")).join(placed, [label, "at"]).select("tree", key, "weight")
    whole = rows.where(~F.col(label).isin(*quotas)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return drawn.union(whole.select("tree", key, F.lit(1).cast("long")))


def clump_plan(counts: DataFrame, shares: dict[int, float]) -> DataFrame:
    """label, n, minority, clumps, quota: balanced sets in which the minority classes have their shares.

    counts: label, n. The set's size is the mean of n / share over the minority classes, rounded; a majority class
    needs n over its part of the rest of that size, both rounded up; the largest need is the number of clumps, and a
    majority class gives ceil(n / clumps) rows to each, a minority class all of its rows."""
    minority = F.col("label").isin(*shares)
    share = F.create_map(*[F.lit(x) for p in shares.items() for x in p])[F.col("label")]
    every = Window.partitionBy()  # a row a class
    rows = counts.withColumn("minority", minority).withColumn("_size", F.floor(F.avg(F.when(minority, F.col("n") / share)).over(every) + 0.5))
    rest = F.sum(F.when(~minority, F.col("n")).otherwise(0)).over(every)
    part = F.ceil(F.round(F.col("_size") * (F.col("n") / rest) * F.lit(1 - sum(shares.values())), 6))
    rows = rows.withColumn("_need", F.when(~minority, F.ceil(F.col("n") / F.greatest(part, F.lit(1)))))
    rows = rows.withColumn("clumps", F.max("_need").over(every))
    return rows.select("label", "n", "minority", "clumps", F.when(F.col("minority"), F.col("n")).otherwise(F.ceil(F.col("n") / F.col("clumps"))).alias("quota"))


def actual_proportions(counts: DataFrame, shares: dict[int, float], smote: bool = False) -> DataFrame:
    """label, attendance, share of each class in what trees are grown on: in one of the balanced sets, or with smote among all
    rows and the made ones. counts: label, n."""
    if smote:
        more = smote_deficits(counts, shares).select("label", "missing")
        rows = counts.join(more, "label", "left").select("label", (F.col("n") + F.greatest(F.coalesce("missing", F.lit(0)), F.lit(0))).alias("attendance"))
    else:
        rows = clump_plan(counts, shares).select("label", F.col("quota").alias("attendance"))
    return rows.withColumn("share", F.col("attendance") / F.sum("attendance").over(Window.partitionBy()))  # a row a class


def balanced_clump(rows: DataFrame, key: str, label: str, quotas: dict[int, int], clump: int, seed: int = 1) -> DataFrame:
    """Rows of balanced set number clump: all of a class without a quota, else quota rows from place clump * quota on in
    the class's shuffled order, cyclically."""
    placed = shuffled_places(rows, key, label, seed)
    sizes = placed.groupBy(label).agg(F.count("*").alias("_n"))
    quota = F.create_map(*[F.lit(x) for p in quotas.items() for x in p])[F.col(label)]
    both = placed.join(F.broadcast(sizes), label)
    return both.where(quota.isNull() | (F.pmod(F.col("at") - quota * clump, F.col("_n")) < quota)).drop("at", "_n")


def node_sample(rows: DataFrame, key: str, node: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each node without replacement."""
    return shuffled_places(rows, key, node, seed).where(F.col("at") < n).drop("at")


def attribute_sample(units: DataFrame, unit: str, attributes: int, keep: int, seed: int = 1) -> DataFrame:
    """unit, attribute: keep of the attributes 0.. for each tree or node, in a random order of its own."""
    rows = units.select(unit, F.explode(F.sequence(F.lit(0), F.lit(attributes - 1))).alias("attribute"))
    order = Window.partitionBy(unit).orderBy(draw(F.col(unit) * attributes + F.col("attribute"), seed), "attribute")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def permuted(rows: DataFrame, key: str, column: str, seed: int = 1) -> DataFrame:
    """rows with the column's values dealt anew by a portable random permutation."""
    taken = shuffled_places(rows.select(key, column, F.lit(0).alias("_all")), key, "_all", seed).select("at", column)
    return numbered(rows.drop(column), key).join(taken, "at").drop("at")


def l1(attributes: list[str], a: str, b: str, discrete: tuple[str, ...] = (), penalty: Column | float = 0.0) -> Column:
    """City-block distance; values of a discrete attribute that differ add the penalty."""
    parts = [F.when(F.col(f"{a}.{c}") != F.col(f"{b}.{c}"), penalty).otherwise(0.0) if c in discrete else F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in attributes]
    return sum(parts[1:], parts[0])


def l2(attributes: list[str], a: str, b: str, discrete: tuple[str, ...] = (), penalty: Column | float = 0.0) -> Column:
    """Euclidean distance; values of a discrete attribute that differ add the penalty's square to the sum."""
    square = penalty * penalty
    parts = [F.when(F.col(f"{a}.{c}") != F.col(f"{b}.{c}"), square).otherwise(0.0) if c in discrete else F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2.0) for c in attributes]
    return F.sqrt(sum(parts[1:], parts[0]))


#: Rows of a block, about, that queries are compared with in one group of the join.
BLOCK_ROWS = 4096


def neighbours(queries: DataFrame, rows: DataFrame, key: str, attributes: list[str], k: int, distance=l2, label: str | None = None) -> DataFrame:
    """key, neighbour, distance, rank: the k nearest of other rows (of the same class with label); earlier rows win ties,
    distances that are null come last.

    Exact: every query (a stated set) meets every row but those that repeat k + 1 earlier ones, in blocks of rows. Pairs
    are neither sorted nor kept: in a first pass the least distance in each of several parts of the rows gives each query a
    bound, the k-th of them, and only pairs within it are ranked. For all rows, see all_neighbours."""
    own = [label] if label else []
    alike = Window.partitionBy(*own, *attributes).orderBy(key)
    few = table(rows.select(key, *own, *attributes).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n"), "neighbour-rows")
    blocks = max(1, -(-few.count() // BLOCK_ROWS))
    fine = max(1, -(-16 * k // blocks))  # parts of a block
    hashed = F.xxhash64(key)
    dealt = few.withColumns({"_block": F.coalesce(F.pmod(hashed, F.lit(blocks)), F.lit(0)), "_part": F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(fine))})
    asked = queries.select(key, *own, *attributes)
    on = (F.col("q._block") == F.col("r._block")) & (F.col(f"q.{key}") != F.col(f"r.{key}"))
    if label:
        on = on & (F.col(f"q.{label}") == F.col(f"r.{label}"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    met = lambda q: q.withColumn("_block", each).alias("q").join(dealt.alias("r").hint("merge"), on)
    away = distance(attributes, "q", "r")
    least = met(asked).groupBy(F.col(f"q.{key}").alias(key), F.col("q._block").alias("_block"), "r._part").agg(F.min(away).alias("_d"))
    order = Window.partitionBy(key).orderBy("_d")  # a row a part
    bound = least.where("_d is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select(key, (F.col("_d") + 1e-8).alias("_bound"))
    bounded = asked.join(bound, key, "left")
    near = met(bounded).where(F.col("q._bound").isNull() | (away <= F.col("q._bound")))
    both = near.select(F.col(f"q.{key}").alias(key), F.col(f"r.{key}").alias("neighbour"), F.round(away, 9).alias("distance"))
    best = Window.partitionBy(key).orderBy(F.asc_nulls_last("distance"), "neighbour")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def median_of_stdev(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """The median of the attributes' population deviations: what a differing discrete value counts in a distance."""
    stats = rows.agg(*[F.stddev_pop(c).alias(c) for c in attributes])
    return stats.select(F.explode(F.array(*attributes)).alias("s")).agg(F.median("s").alias("median_stdev"))


def smote_deficits(counts: DataFrame, shares: dict[int, float]) -> DataFrame:
    """label, n, wanted, missing: rows to make so that each minority class has its share of the whole. counts: label, n."""
    total = sum(shares.values())
    minority = F.col("label").isin(*shares)
    rest = F.sum(F.when(~minority, F.col("n")).otherwise(0)).over(Window.partitionBy())
    share = F.create_map(*[F.lit(x) for p in shares.items() for x in p])[F.col("label")]
    wanted = F.ceil(F.round(share * (rest / (1 - total)), 6))
    return counts.withColumn("wanted", wanted).where(minority).select("label", "n", "wanted", (F.col("wanted") - F.col("n")).alias("missing"))


#: Points of a cell, about, in which a point looks for a first bound of its neighbours' distance.
NEAR = 128


def box_distance(numbers: list[str], a: str, b: str, distance) -> Column:
    """The least distance that points of two boxes (columns _low_<attribute>, _high_<attribute>) can have."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{b}._low_{c}") - F.col(f"{a}._high_{c}"), F.col(f"{a}._low_{c}") - F.col(f"{b}._high_{c}")) for c in numbers]
    return sum(gaps[1:], gaps[0]) if distance is l1 else F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def in_cells(points: DataFrame, axes: list[str], near: int) -> DataFrame:
    """points with _slab and _cell of their group _g: cut into equal parts along the first axis, each of these along the
    second, and so on, until a cell has about near points. Ties are cut by _point."""
    parts = points.withColumn("_cell", F.lit(0).cast("long")).withColumn("_one", F.lit(1))
    for i, axis in enumerate(axes):
        parts = running(parts, ["_g", "_cell"], axis, ["_one"], ["_point"])
        if not i:
            parts = parts.withColumn("_pieces", F.ceil(F.pow(F.col("_one_all") / F.lit(float(near)), F.lit(1 / len(axes)))).cast("long"))
        piece = F.floor((F.col("_one_upto") - 1) * F.col("_pieces") / F.col("_one_all"))
        parts = parts.withColumn("_cell", F.col("_cell") * F.col("_pieces") + piece).drop("_one_upto", "_one_all", "next")
        if not i:
            parts = parts.withColumn("_slab", F.col("_cell"))
    return parts.drop("_one", "_pieces")


def point_neighbours(points: DataFrame, attributes: list[str], k: int, distance, discrete: tuple[str, ...], penalty: float) -> DataFrame:
    """_point, _other, distance: the k nearest other points of the same group of points(_point, _g, attributes), the least
    _point of ties.

    Points are cut into cells with the boxes of their numbers. The k-th distance within a point's own cell bounds how far its
    neighbours are, and a box how near those of another cell can be. Cells are compared where their slabs (cuts along the first
    axis) come near enough, points with the cells that their own bound allows. Only slabs come to the driver: at most the
    square root of the cells."""
    numbers = [c for c in attributes if c not in discrete]
    axes = numbers[:3] if len(numbers) > 1 else numbers * 2
    cell = ["_g", "_cell"]
    data = table(in_cells(points, axes, max(NEAR, 16 * (k + 1))), "neighbour-cells")  # cells have k other points
    boxes = data.groupBy("_g", "_slab", "_cell").agg(*[F.min(c).alias(f"_low_{c}") for c in numbers], *[F.max(c).alias(f"_high_{c}") for c in numbers])
    other = data.select(F.col("_point").alias("_other"), *cell, *attributes)
    away = F.round(distance(attributes, "q", "r", discrete, penalty), 9)
    same = (F.col("q._g") == F.col("r._g")) & (F.col("q._cell") == F.col("r._cell"))
    own = data.alias("q").join(other.alias("r"), same & (F.col("q._point") != F.col("r._other"))).select("q._point", away.alias("_d"))
    order = Window.partitionBy("_point").orderBy("_d")  # of a point those of its cell
    bound = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("_point", (F.col("_d") + 1e-6).alias("_bound"))
    data = table(data.join(bound, "_point", "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf")))), "neighbour-bounds")
    boxes = checkpoint(boxes.join(data.groupBy(*cell).agg(F.max("_bound").alias("_reach")), cell))

    first = numbers[0]
    slabs: dict[int, list[tuple]] = {}
    for r in boxes.groupBy("_g", "_slab").agg(F.min(f"_low_{first}").alias("low"), F.max(f"_high_{first}").alias("high")).collect():  # a row a slab
        slabs.setdefault(r["_g"], []).append((r["_slab"], r["low"], r["high"]))
    known = {g: tuple(np.array(x) for x in zip(*sorted(s))) for g, s in slabs.items()}

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, low, high = (batch.column(i).to_pylist() for i in (0, 2, 3))
            found = []
            for g, a, z in zip(group, low, high, strict=True):
                number, lows, highs = known[g]
                found.append(number[np.searchsorted(highs, a, "left") : np.searchsorted(lows, z, "right")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["_g", "_cell", "_slabs"])

    kind = data.schema["_g"].dataType.simpleString()
    far = boxes.select("_g", "_cell", F.col(f"_low_{first}") - F.col("_reach"), F.col(f"_high_{first}") + F.col("_reach")).mapInArrow(reach, f"_g {kind}, _cell long, _slabs array<long>")
    asked = boxes.join(far, cell).withColumn("_slab", F.explode("_slabs"))
    near = asked.alias("a").join(boxes.alias("b"), (F.col("a._g") == F.col("b._g")) & (F.col("a._slab") == F.col("b._slab")) & (box_distance(numbers, "a", "b", distance) <= F.col("a._reach")))
    near = near.select("a._g", "a._cell", F.col("b._cell").alias("_to"), *[F.col(f"b.{x}_{c}").alias(f"{x}_{c}") for c in numbers for x in ("_low", "_high")])
    queries = data.select("_point", *cell, "_bound", *attributes, *[F.col(c).alias(f"{x}_{c}") for c in numbers for x in ("_low", "_high")])
    sent = queries.alias("q").join(near.alias("n"), (F.col("q._g") == F.col("n._g")) & (F.col("q._cell") == F.col("n._cell")) & (box_distance(numbers, "q", "n", distance) <= F.col("q._bound")))
    sent = sent.select("q._point", "q._g", "n._to", "q._bound", *[f"q.{c}" for c in attributes])
    both = sent.alias("q").join(other.alias("r"), (F.col("q._g") == F.col("r._g")) & (F.col("q._to") == F.col("r._cell")) & (F.col("q._point") != F.col("r._other")))
    both = both.select("q._point", "r._other", away.alias("distance"), "q._bound").where(F.col("distance") <= F.col("_bound"))
    best = Window.partitionBy("_point").orderBy("distance", "_other")
    return both.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("_point", "_other", "distance")


def all_neighbours(rows: DataFrame, key: str, attributes: list[str], k: int, distance=l2, discrete: tuple[str, ...] = (), penalty: float = 0.0, within: str | None = None) -> DataFrame:
    """key, neighbour, distance, rank: the k nearest other rows (with within, those of the same value of that column) of
    every row; lower keys win ties. The first attribute is a number; rows with a null attribute take no part.

    Exact without comparing all rows. Rows of equal attributes are one point, named by its least key, with its k + 1 least
    keys: nobody needs more of them. Neighbours are found between points (point_neighbours)."""
    full = reduce(lambda x, c: x & F.col(c).isNotNull(), attributes, F.lit(True))
    plain = rows.where(full).select(key, (F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")).alias("_g"), *[F.col(c).cast("double").alias(c) if c not in discrete else F.col(c) for c in attributes])
    alike = ["_g", *attributes]
    least = plain.withColumn("_n", F.row_number().over(Window.partitionBy(*alike).orderBy(key))).where(F.col("_n") <= k + 1)  # cut before the shuffle too
    points = least.groupBy(*alike).agg(F.min(key).alias("_point"), F.sort_array(F.collect_list(key)).alias("_keys"))  # k + 1 keys
    points = table(points, "neighbour-points")
    near = point_neighbours(points.drop("_keys"), attributes, k, distance, discrete, penalty)
    listed = near.join(points.select(F.col("_point").alias("_other"), "_keys"), "_other").select("_point", "distance", "_keys")
    listed = listed.unionByName(points.select("_point", F.lit(0.0).alias("distance"), "_keys"))
    # a point's candidates: at most (k + 1) squared rows
    listed = listed.groupBy("_point").agg(F.collect_list(F.struct("distance", "_keys")).alias("_all"))
    whose = plain.join(points.drop("_keys"), alike).select(key, "_point")
    each = whose.join(listed, "_point").select(key, F.explode("_all").alias("_a")).select(key, "_a.distance", F.explode("_a._keys").alias("neighbour")).where(F.col("neighbour") != F.col(key))
    best = Window.partitionBy(key).orderBy("distance", "neighbour")
    return each.select(key, "neighbour", "distance").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def smote(rows: DataFrame, key: str, attributes: list[str], near: DataFrame, copies: DataFrame, seed: int = 1, discrete: tuple[str, ...] = ()) -> DataFrame:
    """Synthetic rows: key, copy, attributes, between a row and one of its neighbours at a portable random share of the way;
    a discrete attribute takes the most frequent value of the row's neighbours, the least of ties.

    near: key, neighbour, rank. copies: key, copy: what to make from which row. A row without neighbours makes none."""
    count = near.groupBy(key).agg(F.max("rank").alias("_k"))
    base = copies.join(rows.select(key, *attributes), key).join(count, key)
    seeded = F.col("copy")
    base = base.withColumn("rank", (draw(seeded, seed) % F.col("_k") + 1).cast("int")).withColumn("_u", draw(seeded, seed + 1) / F.lit(float(MODULUS)))
    other = rows.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"_n_{c}") for c in attributes])
    pairs = near.select(key, "neighbour", "rank").join(other, "neighbour")
    both = base.join(pairs, [key, "rank"])
    if discrete:
        both = both.join(pairs.groupBy(key).agg(*[F.mode(f"_n_{c}", True).alias(f"_m_{c}") for c in discrete]), key)
    value = lambda c: F.col(f"_m_{c}") if c in discrete else F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))
    return both.select(key, "copy", *[value(c).alias(c) for c in attributes])


def smote_classes(rows: DataFrame, key: str, attributes: list[str], missing: dict[int, int], k: int = 5, distance: str = "l2", discrete: list[str] | None = None, closed: bool = True, seed: int = 1) -> DataFrame:
    """label, copy (from 0 over all), attributes of missing[label] synthetic rows for each of those classes.

    Base are all rows of the class, each in turn; neighbours are of the class (closed) or of any (open). A class of fewer
    than 2 rows raises. A number comes first among the attributes."""
    discrete = discrete or []
    missing = {c: n for c, n in missing.items() if n > 0}
    ordered = sorted(attributes, key=lambda a: a in discrete)
    few = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("label").isin(*missing)).collect()  # a row a class
    sizes = {r["label"]: r["n"] for r in few}
    if any(sizes.get(c, 0) < 2 for c in missing):
        raise ValueError("a class of fewer than 2 rows has no neighbours")
    penalty = median_of_stdev(rows, [a for a in attributes if a not in discrete]).first()[0] if discrete else 0.0
    numbered_rows = shuffled_places(rows.where(F.col("label").isin(*missing)).select(key, "label"), key, "label", seed)
    starts, total = {}, 0
    for c in sorted(missing):
        starts[c], total = total, total + missing[c]
    which = lambda values: F.create_map(*[F.lit(int(x)) for p in values.items() for x in p])[F.col("label")]
    # copy j of a class is made from the row of place j modulo the class's size
    made = F.when(F.col("at") < which(missing), F.sequence(F.col("at").cast("long"), which(missing).cast("long") - 1, which(sizes).cast("long")))
    copies = numbered_rows.withColumn("_j", F.explode(made)).select(key, "label", (which(starts) + F.col("_j")).alias("copy"))
    base = rows.where(F.col("label").isin(*missing)) if closed else rows
    near = all_neighbours(base, key, ordered, k, l1 if distance == "l1" else l2, tuple(discrete), penalty, "label" if closed else None)
    out = smote(rows, key, attributes, table(near, "smote-neighbours"), copies.select(key, "copy"), seed, tuple(discrete))
    return out.join(copies.select("copy", "label"), "copy").select("label", "copy", *attributes)


def boost_round(rows: DataFrame, weight: str, wrong: Column) -> DataFrame:
    """AdaBoost.M1: rows with the next weight, error and beta; right rows times beta, then renormalised. An error of 0
    or of a half and more leaves the weights as they are (the sequence ends there)."""
    error = rows.agg((F.sum(F.when(wrong, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("error"))
    beta = F.col("error") / (1 - F.col("error"))
    both = rows.crossJoin(F.broadcast(error)).withColumn("beta", beta)
    go = (F.col("error") > 0) & (F.col("error") < 0.5)
    both = both.withColumn("_w", F.when(go & ~wrong, F.col(weight) * F.col("beta")).otherwise(F.col(weight)))
    total = both.agg(F.sum("_w").alias("_t"))
    return both.crossJoin(F.broadcast(total)).withColumn("next_weight", F.col("_w") / F.col("_t")).drop("_w", "_t")


#: Draws that fall into a cell of the cumulative weight, about.
CELL_DRAWS = 8


def weighted_draw(rows: DataFrame, key: str, weight: str, draws: int, seed: int = 1, cells: int | None = None) -> DataFrame:
    """draw, key: draws with replacement in proportion to an integer weight; a range join made an equi-join on cells of
    the cumulative weight, of CELL_DRAWS draws about (1024 cells at least): a draw meets the rows of its cell, as few
    however many draws and rows there are. The cumulative weight is two-level: ranges of the key, then rows of a range."""
    cells = cells or max(1024, draws // CELL_DRAWS)
    total = rows.agg(F.sum(weight)).first()[0] or 0
    cum = running(rows.select(key, weight), [], key, [weight]).select(key, (F.col(f"{weight}_upto") - F.col(weight)).alias("low"), F.col(f"{weight}_upto").alias("high"))
    width = total // cells + 1
    cum = cum.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    u = (draw(F.col("id"), seed) * MODULUS + draw(F.col("id"), seed + 1)) % max(total, 1)
    # never null, and said so: else the join filters by the whole formula once more, too long to be compiled
    points = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.coalesce(u, F.lit(0)).alias("u")).withColumn("cell", F.coalesce(F.floor(F.col("u") / width), F.lit(0)))
    return points.join(cum, "cell").where("u >= low and u < high").select("draw", key)


def bite(rows: DataFrame, key: str, wrong: Column, error: float, size: int, seed: int = 1) -> DataFrame:
    """key, weight: size draws with replacement in which a right row is as likely as error / (1 - error) of a wrong one:
    the law of drawing rows and rejecting right ones, without its loop."""
    right = int(1000 * min(1.0, error / max(1e-9, 1 - error)))
    weighed = rows.select(key, F.when(wrong, 1000).otherwise(right).cast("long").alias("_w"))
    return weighted_draw(weighed, key, "_w", size, seed).groupBy(key).agg(F.count("*").alias("weight"))
