"""Sequential ensembles and importances: boosting, importance-sampled voting, permutation and structural importance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scalars import draw, drawn
from coppice.operators import sampling, scoring
from coppice.operators.grow import ALIKE, grow
from coppice.operators.scoring import Node
from coppice.operators.votes import VoteStore
from coppice.plans.materialize import checkpoint, table

#: Integer scale of a boosting weight that is 1 on average.
SCALE = 1 << 16
#: Rows of a bite that are sent to all others.
FEW_TAKEN = 1 << 17
#: Rows of a tree, at most about, whose values are dealt anew in one part, and into how many ranges (2 ** DEALT_BITS) a part's draws are cut to count them.
DEALT_ROWS, DEALT_BITS = 1 << 18, 3


def boost(rows: DataFrame, row: str, attributes: list[str], classes: int, rounds: int, depth: int | None = None, seed: int = 1, growth: dict | None = None, synthetic: Callable[[DataFrame], DataFrame] | None = None) -> tuple[list[Node], list[float]]:
    """Trees and betas of AdaBoost.M1 by resampling: each tree grows on as many weighted draws as rows.

    growth: more arguments of grow. synthetic: adds rows (with keys below 0) to the drawn ones, for one round's tree alone.

    Ends early at a tree that errs never (kept, its beta the least that n rows could show) or on half of the weight
    (left out). Rows are written once, in blocks along their key; where they are ALIKE or more times as many as their different
    labels and attributes, such rows, which have one weight, are drawn as one. A row's weight is found from the trees so far, and a
    round's draws are shared out among the blocks and within them, so that the rows drawn are all that a round writes. A
    number a block comes to the driver."""
    kinds = {"depth": depth} | (growth or {})
    same = ["label", *attributes]
    n, different = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*same))).first()
    if synthetic or kinds.get("subsample") or different * ALIKE > n:
        state = rows.select(row, *same, F.lit(1).cast("long").alias("_n"))
    else:
        state = rows.groupBy(*same).agg(F.min(row).alias(row), F.count("*").alias("_n")).select(row, *same, "_n")
    places = sampling.numbered(table(state, "boost-rows"), row, "_at")
    order = F.sort_array(F.collect_list(F.struct("_at", *state.columns)))
    blocks = table(places.groupBy(F.shiftright("_at", sampling.BAG_BITS).alias("_block")).agg(order.alias("_rows")), "boost-blocks")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name != "_n")
    said: list[tuple] = []
    trees: list[Node] = []
    betas: list[float] = []

    def along(make: Callable, kinds: str) -> DataFrame:
        """make(block, its rows, their weights, whether the last tree is wrong) of each block."""
        sent = blocks.sparkSession.sparkContext.broadcast(list(said))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, block in enumerate(batch.column(0).to_pylist()):
                    own = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(1).slice(i, 1).flatten())])
                    values, label = scoring.matrix([own[a] for a in attributes], own.num_rows), own["label"].fill_null(-1).to_numpy()
                    weight, wrong = np.ones(own.num_rows), np.zeros(own.num_rows, bool)
                    for flat, labels, beta, scale in sent.value:
                        wrong = (labels[flat.walk(values)] != label) & (label >= 0)
                        if scale is not None:
                            weight = np.where(wrong, weight, weight * beta) * scale
                    yield make(block, own, weight, wrong)

        return blocks.mapInArrow(each, kinds)

    def whole(weight: np.ndarray, own: pa.Table) -> np.ndarray:
        return np.floor(weight * SCALE + 0.5).astype(np.int64) * own["_n"].to_numpy()

    def summed(block: int, own: pa.Table, weight: np.ndarray, wrong: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": [block], "n": [int(whole(weight, own).sum())]})

    def erred(block: int, own: pa.Table, weight: np.ndarray, wrong: np.ndarray) -> pa.RecordBatch:
        weight = weight * own["_n"].to_numpy()
        return pa.RecordBatch.from_pydict({"block": [block], "wrong": [float(weight[wrong].sum())], "all": [float(weight.sum())]})

    for t in range(rounds):
        sums = sorted(tuple(r) for r in along(summed, "block long, n long").collect())  # a row a block
        share = sampling.shared([s for _, s in sums], n, seed + 10 * t)
        draws = rows.sparkSession.sparkContext.broadcast(dict(zip([b for b, _ in sums], share.tolist(), strict=True)))

        def pick(block: int, own: pa.Table, weight: np.ndarray, wrong: np.ndarray, draws=draws, key=seed + 10 * t) -> pa.RecordBatch:
            found = sampling.shared(whole(weight, own), draws.value[block], key, 1 + block)
            at = pa.array(np.flatnonzero(found))
            weights = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(found[found > 0]))
            return pa.RecordBatch.from_arrays([*[own[c].combine_chunks().take(at) for c in (row, *same)], weights], [row, *same, "_weights"])

        bag = table(along(pick, f"{kept}, _weights array<long>"), "boost-drawn")
        if synthetic:
            made = synthetic(bag.drop("_weights")).where(F.col(row) < 0).select(row, *same, F.array(F.lit(1).cast("long")).alias("_weights"))
            bag = table(bag.unionByName(made), "boost-synthetic")
        tree = grow(bag, row, attributes, classes, weights="_weights", **kinds | {"seed": seed + t})[0]
        flat, nodes = scoring.flatten(tree, attributes)
        said.append((flat, np.array([x.label for x in nodes], np.int32), None, None))
        errors = [(r["wrong"], r["all"]) for r in along(erred, "block long, wrong double, all double").orderBy("block").collect()]  # a row a block
        error = math.fsum(w for w, _ in errors) / (math.fsum(a for _, a in errors) or 1.0)
        if error >= 0.5:
            break
        trees.append(tree)
        betas.append(max(error, 0.5 / max(n, 1)) / (1 - error))
        if error == 0:
            break
        beta = error / (1 - error)
        said[-1] = (*said[-1][:2], beta, 1 / (error + (1 - error) * beta))
    return trees, betas


def ivote(*args, **kinds) -> tuple[list[Node], list[float]]:
    """The trees and the smoothed errors of ivote_followed."""
    return ivote_followed(*args, **kinds)[:2]


def ivote_followed(rows: DataFrame, row: str, attributes: list[str], classes: int, rounds: int, size: int = 50, memory: float = 0.75, depth: int | None = None, seed: int = 1, growth: dict | None = None, quotas: dict[int, int] | None = None, test: DataFrame | None = None) -> tuple[list[Node], list[float], VoteStore, DataFrame | None]:
    """Trees on small bites that favour rows the out-of-bag vote gets wrong, the smoothed error of each round, the
    out-of-bag votes, and the curve of test rows (tree, rows, error, accuracy), if there are any.

    A row that no tree has voted on counts as wrong. The error of a round is that of the rows outside its own bite,
    smoothed by memory. Votes are appended to a store; rows keep their counts of votes beside them, and a bite is sent to them if it is small. quotas (of the majority
    classes): only their rows are drawn by what the vote gets wrong, quota of each class, and all rows of the others are in
    every bite."""
    kinds = {"depth": depth} | (growth or {})
    data = table(rows.select(row, "label", *attributes), "ivote-rows")
    v = [F.col(f"v{k}") for k in range(classes)]
    wrong = (sum(v[1:], v[0]) == 0) | (scoring.winner(v) != F.col("label"))
    store = VoteStore(rows.sparkSession, row, classes, "ivote-votes")
    tests = VoteStore(rows.sparkSession, row, classes, "ivote-tests") if test is not None else None
    trees: list[Node] = []
    errors: list[float] = []
    told: DataFrame | None = None
    for t in range(rounds):
        error = errors[-1] if errors else 0.5
        state = data.select(row, "label", (wrong if t else F.lit(True)).alias("_wrong"))
        if quotas:
            bites = [sampling.bite(state.where(F.col("label") == k), row, F.col("_wrong"), error, q, seed + 10 * t + k) for k, q in sorted(quotas.items())]
            whole = state.where(~F.col("label").isin(*quotas)).select(row, F.lit(1).cast("long").alias("weight"))
            taken = checkpoint(reduce(DataFrame.unionByName, bites, whole))
        else:
            taken = checkpoint(sampling.bite(state, row, F.col("_wrong"), error, size, seed + 10 * t))
        few = taken.count() <= FEW_TAKEN
        marked = (lambda x: F.broadcast(x)) if few else (lambda x: x)
        bite = table(data.select(row, "label", *attributes).join(marked(taken.select(row, F.array(F.col("weight").cast("int")).alias("_weights"))), row), "ivote-bite")
        tree = grow(bite, row, attributes, classes, weights="_weights", **kinds | {"seed": seed + t})[0]
        trees.append(tree)
        said = lambda df: scoring.votes(df, [row, "label"], [tree], classes).select(row, "label", F.lit(t).alias("tree"), "pred")
        voted = scoring.said(data, data.columns, [tree], classes, "_said").join(marked(taken.select(row, F.lit(True).alias("_taken"))), row, "left")
        curve, data = store.append_beside(voted.withColumn("_said", F.when(F.col("_taken").isNull(), F.col("_said")).otherwise(F.array(F.lit(None).cast("int")))).drop("_taken"), "_said", t, 1)
        now = curve.first()
        now = now["error"] if now else 0.0
        errors.append(now if not errors else memory * errors[-1] + (1 - memory) * now)
        if tests is not None:
            curve = tests.append(said(test))
            told = curve if told is None else checkpoint(told.unionByName(curve))  # a row a tree
    return trees, errors, store, told


def noised_importance(rows: DataFrame, row: str, attributes: list[str], trees: list[Node], classes: int, in_bag: DataFrame | None = None, seed: int = 1, outside: Column | None = None) -> DataFrame:
    """attribute, error, noised_error, importance: by how many percent the out-of-bag error of the trees grows when each
    tree's out-of-bag rows deal an attribute's values among themselves. Null where the error is 0. in_bag(tree, row), or outside, a
    row's array of the trees whose bags it is not in, which saves a join. Rows without a key take no part.

    The error is that of the cumulative out-of-bag vote of all trees, at the rows out of the last tree's bag. The row at a place of
    its tree's out-of-bag rows by one draw gets the values of the row at that place by another, the same one for all attributes.
    Rows are shuffled once in both parts: a part has a range of the first order, and those ranges of the second whose places, by
    their counts, reach into it. What the trees say of a row, of its own values too, is shuffled once more."""
    last = len(trees) - 1
    if outside is None:
        bags = in_bag.groupBy(row).agg(F.collect_set(F.col("tree").cast("int")).alias("_in"))
        rows = rows.join(bags, row, "left")
        outside = F.array_except(F.sequence(F.lit(0), F.lit(last)), F.coalesce("_in", F.array().cast("array<int>")))
    out = rows.where(F.col(row).isNotNull()).select(row, "label", *[F.col(a).cast("double").alias(a) for a in attributes], outside.cast("array<int>").alias("_out"))
    out = table(out.where(F.size("_out") > 0), "noised-rows")
    bits = max(0, -(-out.count() // DEALT_ROWS) - 1).bit_length()
    at = lambda seed, more=0: F.shiftright(F.coalesce(draw(F.col(row), seed), F.lit(0)), 31 - bits - more).cast("int")
    each = out.select(row, "label", *attributes, F.array_contains("_out", F.lit(last)).alias("_asked"), F.explode("_out").alias("tree"))
    ranges = each.select("tree", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), at(seed + i, DEALT_BITS).alias("range")) for i in (0, 1)])).alias("x"))
    ranges = ranges.groupBy("tree", "x.side", "x.range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree", "side").orderBy("range")) - F.col("n")  # a row a range
    ranges = checkpoint(ranges.withColumn("low", before))
    parts = ranges.where("side = 0").groupBy("tree", F.shiftright("range", DEALT_BITS).alias("part")).agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    met = ranges.where("side = 1").alias("g").join(parts.alias("p"), (F.col("g.tree") == F.col("p.tree")) & (F.col("g.low") < F.col("p.low") + F.col("p.n")) & (F.col("p.low") < F.col("g.low") + F.col("g.n")))
    met = checkpoint(met.select("g.tree", "range", "part", F.col("g.low").alias("first"), F.col("p.low").alias("low")))
    sent = met.groupBy("tree", "range").agg(F.collect_list("part").alias("parts"))  # a part or two
    ahead = {(r["tree"], r["part"]): r["n"] for r in met.groupBy("tree", "part").agg((F.min("low") - F.min("first")).alias("n")).collect()}  # a row a part
    known = rows.sparkSession.sparkContext.broadcast((ahead, [(flat, np.array([n.label for n in nodes], np.int32)) for flat, nodes in (scoring.flatten(t, attributes) for t in trees)]))

    # rows whose votes don't count only keep a place
    gets = each.select("tree", at(seed).alias("part"), F.lit(0).alias("_side"), row, "_asked", *[F.when(F.col("_asked"), F.col(c)).alias(c) for c in ("label", *attributes)])
    gives = each.withColumn("range", at(seed + 1, DEALT_BITS)).join(F.broadcast(sent), ["tree", "range"])  # a row a range
    gives = gives.select("tree", F.explode("parts").alias("part"), F.lit(1).alias("_side"), row, F.lit(False).alias("_asked"), F.lit(None).cast(out.schema["label"].dataType).alias("label"), *attributes)

    def deal(key: tuple, own: pa.Table) -> pa.Table:
        tree, part = (x.as_py() for x in key)
        found, of = known.value
        ids, side = own[row].combine_chunks().cast(pa.int64()).to_numpy(), own["_side"].to_numpy()
        own = own.append_column("_draw", pa.array(np.where(side == 0, drawn(ids, seed), drawn(ids, seed + 1))))
        own = own.sort_by([("_side", "ascending"), ("_draw", "ascending"), (row, "ascending")]).combine_chunks()
        n, skip, (flat, labels) = int((side == 0).sum()), found.get((tree, part), 0), of[tree]
        values = scoring.matrix([own[a] for a in attributes], own.num_rows)
        asked = np.flatnonzero(own["_asked"].to_numpy()[:n])
        mine, theirs = values[asked], values[n + skip + asked]
        said = [labels[flat.walk(mine)]]
        for i in range(len(attributes)):
            dealt = mine.copy()
            dealt[:, i] = theirs[:, i]
            said.append(labels[flat.walk(dealt)])
        offsets = pa.array(np.arange(0, len(asked) * len(said) + 1, len(said), dtype=np.int32))
        own = own.take(pa.array(asked))
        return pa.table({row: own[row], "label": own["label"], "said": pa.ListArray.from_arrays(offsets, pa.array(np.stack(said, axis=1).reshape(-1).astype(np.int8)))})

    kinds = f"`{row}` {out.schema[row].dataType.simpleString()}, label {out.schema['label'].dataType.simpleString()}, said array<tinyint>"
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (ranges.agg(F.sum("n")).first()[0] or 0) // DEALT_ROWS // 2)
    said = gets.unionByName(gives).repartition(partitions, "tree", "part").groupBy("tree", "part").applyInArrow(deal, kinds)
    which = range(len(attributes) + 1)
    counts = [F.count_if(F.col("said")[i] == k).alias(f"v{i}_{k}") for i in which for k in range(classes)]
    counts = said.repartition(partitions, row).groupBy(row, "label").agg(*counts)  # as it is dealt
    wrong = lambda i: F.when(scoring.winner([F.col(f"v{i}_{k}") for k in range(classes)]) != F.col("label"), 1.0).otherwise(0.0)
    found = counts.agg(*[F.avg(wrong(i)).alias(f"e{i}") for i in which]).where("e0 is not null")
    noised = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"e{i + 1}").alias("noised_error")) for i, a in enumerate(attributes)])
    found = found.select(F.col("e0").alias("error"), F.explode(noised).alias("x")).select("x.attribute", "error", "x.noised_error")
    return found.withColumn("importance", 100 * F.try_divide(F.col("noised_error") - F.col("error"), "error"))


def permutation_importance(rows: DataFrame, row: str, attributes: list[str], trees: list[Node], classes: int, seed: int = 1) -> DataFrame:
    """attribute, error, noised_error, importance: by how many percent the ensemble's vote errs more often when the
    attribute's values are dealt anew among all rows. Null where the error is 0. See noised_importance for out-of-bag rows."""
    arrays = None if scoring.few(trees) else scoring.packed(trees, classes)

    def errors(df: DataFrame, name: str) -> DataFrame:
        v = scoring.tallies(df, [row, "label"], trees, classes, arrays=arrays)
        return v.agg(F.avg(F.when(scoring.winner([F.col(f"v{k}") for k in range(classes)]) != F.col("label"), 1.0).otherwise(0.0)).alias(name))

    base = errors(rows, "error")
    noised = None
    for i, a in enumerate(attributes):
        one = errors(sampling.permuted(rows.select(row, "label", *attributes), row, a, seed + i), "noised_error").withColumn("attribute", F.lit(a))
        noised = one if noised is None else noised.union(one)
    both = noised.crossJoin(F.broadcast(base))  # a row an attribute, and one
    return both.select("attribute", "error", "noised_error", (100 * F.try_divide(F.col("noised_error") - F.col("error"), "error")).alias("importance"))


def structural_importance(spark, trees: list[Node]) -> DataFrame:
    """attribute, path, depth: each leaf's rows over its depth go to all tests above it; each test gives 1 / (depth + 1).
    Both are shares of 1. A single leaf has no tests."""
    found: list[tuple[str, float, float]] = []

    for tree in trees:
        todo: list[tuple[Node, tuple]] = [(tree, ())]  # a node and the tests above it, the last one first
        while todo:
            node, above = todo.pop()
            if node.attribute is None:
                names = []
                while above:
                    name, above = above
                    names.append(name)
                found.extend((a, sum(node.counts) / len(names), 0.0) for a in names)
                continue
            level, up = 1, above
            while up:
                level, up = level + 1, up[1]
            found.append((node.attribute, 0.0, 1 / level))
            todo += [(c, (node.attribute, above)) for c in node.children]
    sums = spark.createDataFrame(found, "attribute string, path double, depth double").groupBy("attribute").agg(F.sum("path").alias("path"), F.sum("depth").alias("depth"))
    whole = sums.agg(F.sum("path").alias("_p"), F.sum("depth").alias("_d"))
    return sums.crossJoin(F.broadcast(whole)).select("attribute", F.try_divide("path", "_p").alias("path"), F.try_divide("depth", "_d").alias("depth"))


def default_attributes(n: int) -> int:
    """Attributes tried at a node of a random forest: ceil(log2(n)) + 1."""
    return math.ceil(math.log2(n)) + 1 if n > 1 else 1
