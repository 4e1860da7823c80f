"""Training, testing and cross-validation of ensembles, with their options as keywords."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators import metrics, prep, sampling, scoring, train
from coppice.operators.grow import grow
from coppice.operators.scoring import Node
from coppice.operators.votes import VoteStore
from coppice.plans.materialize import checkpoint, table
from coppice.sources.models import Ensemble

#: What the options may be.
SPLITS = ("c45", "infogain", "gainratio", "hellinger")


@dataclass(frozen=True)
class Options:
    """What an ensemble is made of.

    Trees: split (criterion), least and dynamic (bounds of a branch's rows), collapse, zero_gain, subsample (rows on which
    a node's split is chosen), depth. Sampling: bagging (percent of the rows, None: all rows once), forest (attributes a
    node tries; 0: the default number), subspaces (percent of the attributes a tree uses), extremely_random (attributes
    tried, each with one random cut), totally_random. Sequences: boosting, ivoting with bite, factor. Number of trees: trees,
    or with stopping blocks of build trees until the out-of-bag accuracy, smoothed over slide trees, rises no more, at most
    trees. Skew: minority (class: its share), used by balanced (clumps), majority_bagging, majority_ivoting, smote (open or
    closed neighbours) and smoteboost (all or subset: rows made from all rows, or from those that were drawn)."""

    trees: int = 10
    split: str = "c45"
    least: int = 2
    dynamic: bool = True
    collapse: bool = True
    zero_gain: bool = False
    subsample: int = 0
    depth: int | None = None
    bagging: int | None = 100
    forest: int | None = None
    subspaces: int | None = None
    extremely_random: int | None = None
    totally_random: bool = False
    boosting: bool = False
    ivoting: bool = False
    bite: int = 50
    factor: float = 0.75
    stopping: bool = False
    slide: int = 5
    build: int = 20
    minority: Mapping[int, float] = field(default_factory=dict)
    balanced: bool = False
    majority_bagging: bool = False
    majority_ivoting: bool = False
    smote: str | None = None
    smoteboost: str | None = None
    neighbours: int = 5
    distance: str = "l2"
    seed: int = 1

    def __post_init__(self) -> None:
        skewed = [n for n in ("balanced", "majority_bagging", "majority_ivoting", "smote", "smoteboost") if getattr(self, n)]
        wrong = {
            f"split is one of {SPLITS}": self.split not in SPLITS,
            "trees are 1 at least": self.trees < 1,
            "bagging and subspaces are above 0": (self.bagging is not None and self.bagging <= 0) or (self.subspaces is not None and not 0 < self.subspaces <= 100),
            "forest, extremely_random and totally_random exclude each other": (self.forest is not None) + (self.extremely_random is not None) + self.totally_random > 1,
            "boosting and ivoting exclude each other": (self.boosting or self.smoteboost is not None) and (self.ivoting or self.majority_ivoting),
            "stopping takes bags": self.stopping and (self.bagging is None or self.boosting or self.ivoting or self.smoteboost is not None or self.majority_ivoting),
            f"{', '.join(skewed)} need the minority's shares": bool(skewed) and not self.minority,
            "shares are above 0 and below 1 together": any(x <= 0 for x in self.minority.values()) or sum(self.minority.values()) >= 1,
            "balanced and majority_bagging exclude each other": self.balanced and self.majority_bagging,
            "smote is open or closed, smoteboost all or subset": self.smote not in (None, "open", "closed") or self.smoteboost not in (None, "all", "subset"),
            "distance is l1 or l2": self.distance not in ("l1", "l2"),
        }
        for message, found in wrong.items():
            if found:
                raise ValueError(message)

    def growth(self, attributes: int) -> dict:
        tried = self.extremely_random if self.extremely_random is not None else self.forest
        tried = train.default_attributes(attributes) if tried == 0 else tried
        cuts = "extremely_random" if self.extremely_random is not None else "totally_random" if self.totally_random else "best"
        return {"criterion": self.split, "depth": self.depth, "attributes_a_node": tried, "cuts": cuts, "fixed": self.least, "dynamic": self.dynamic, "zero_gain": self.zero_gain, "collapse": self.collapse, "subsample": self.subsample, "seed": self.seed}

    def described(self) -> str:
        """The options that differ from the defaults, a line each."""
        plain = Options()
        return "".join(f"{n}: {getattr(self, n)}\n" for n in self.__dataclass_fields__ if getattr(self, n) != getattr(plain, n))


@dataclass(frozen=True)
class Model:
    """An ensemble of numbered attributes (discrete ones: codes), and what a new table needs to be scored by it."""

    ensemble: Ensemble
    imputed: DataFrame | None = None  # a row: what replaces missing values
    trace: DataFrame | None = None  # out-of-bag curve of a training that watches it
    cast: VoteStore | None = None  # the out-of-bag votes of such a training
    tests: DataFrame | None = None  # curve of the rows that were tested while training: tree, rows, error, accuracy

    @property
    def trees(self) -> list[Node]:
        return list(self.ensemble.trees)

    @cached_property
    def arrays(self) -> scoring.Packed | None:
        return None if scoring.few(self.trees) else scoring.packed(self.trees, self.ensemble.classes)

    def full(self, rows: DataFrame) -> DataFrame:
        return prep.impute(rows, self.imputed) if self.imputed is not None else rows

    def votes(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        return scoring.votes(self.full(rows), keep, self.trees, self.ensemble.classes, self.arrays)

    def tallies(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, v0.. (votes), p0.. (mean leaf probabilities) of every row; of a boosted ensemble weighted."""
        weights = [math.log2(1 / b) for b in self.ensemble.betas] if self.ensemble.betas else None
        return scoring.tallies(self.full(rows), keep, self.trees, self.ensemble.classes, weights, self.arrays)

    def transform(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, v0.., p0.., pred of every row: most probable class, of a boosted ensemble the one of most weighted votes."""
        return predicted(self.tallies(rows, keep), self.ensemble.classes, bool(self.ensemble.betas))


def vote_weight(betas: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.log2(F.lit(1 / b)) for b in betas]), F.col("tree") + 1)


def predicted(tally: DataFrame, classes: int, boosted: bool = False) -> DataFrame:
    return tally.withColumn("pred", scoring.winner([F.col(f"{'v' if boosted else 'p'}{k}") for k in range(classes)]))


def fit(rows: DataFrame, row: str, attributes: list[str], classes: int, options: Options = Options(), discrete: dict[str, int] | None = None, test: DataFrame | None = None) -> Model:
    """A model of rows(row, label, attributes). Missing values are replaced by the median or mode of the rows; rows without
    a label take no part. Sequential kinds (boosting, ivoting) and stopping grow tree by tree or block by block.

    test: rows with labels whose vote is followed while training, tree by tree (but for boosted trees, whose weights are
    known at the end only)."""
    discrete = discrete or {}
    known = rows.where("label is not null").select(row, "label", *attributes)
    imputed = checkpoint(prep.imputed_values(known, [a for a in attributes if a not in discrete], [a for a in attributes if a in discrete]))
    known = table(prep.impute(known, imputed), "training")
    o, kinds = options, options.growth(len(attributes)) | {"discrete": discrete}
    values = imputed.first()
    made = Ensemble((), classes, tuple(attributes), discrete, imputed=tuple("" if values[a] is None else f"{values[a]:g}" for a in attributes))
    if test is not None:
        test = table(prep.impute(test.where("label is not null").select(row, "label", *attributes), imputed), "training-test")
    if o.smote:
        known = table(with_synthetic(known, row, attributes, discrete, o, o.smote == "closed"), "training-smote")
    if o.boosting or o.smoteboost:
        synthetic = (lambda drawn: with_synthetic(drawn if o.smoteboost == "subset" else known, row, attributes, discrete, o, True)) if o.smoteboost else None
        trees, betas = train.boost(known, row, attributes, classes, o.trees, seed=o.seed, growth=kinds, synthetic=synthetic)
        return Model(replace(made, trees=tuple(trees), betas=tuple(betas)), imputed)
    if o.ivoting or o.majority_ivoting:
        quotas = clumps(known, o.minority)[0] if o.majority_ivoting else None
        trees, errors, cast, told = train.ivote_followed(known, row, attributes, classes, o.trees, o.bite, o.factor, seed=o.seed, growth=kinds, quotas=quotas, test=test)
        trace = known.sparkSession.createDataFrame(list(enumerate(errors)), "tree int, error double")
        return Model(replace(made, trees=tuple(trees)), imputed, trace, cast, told)
    trees, trace, told = [], None, None
    cast = VoteStore(known.sparkSession, row, classes, "oob-votes") if o.stopping else None
    tests = VoteStore(known.sparkSession, row, classes, "test-votes") if test is not None else None
    beside = o.bagging is not None and not (o.balanced or o.majority_bagging)  # rows keep their weights and votes beside them
    if beside:
        known = table(sampling.numbered(known, row), "training-places")
        total, held = known.count(), known
    while len(trees) < o.trees:
        n = min(o.build, o.trees - len(trees)) if o.stopping else o.trees
        if beside:
            bags, held = None, table(sampling.bag_weights(held, total, n, o.bagging, o.seed + len(trees), "_weights"), "bags")
        else:
            bags, held = drawn_bags(known, row, n, replace(o, seed=o.seed + len(trees)), len(trees)), known
        masks = subspaces(known.sparkSession, len(attributes), n, o.subspaces, o.seed + len(trees))
        trees += grow(held, row, attributes, classes, bags, n, masks=masks, weights="_weights" if beside else None, **kinds | {"seed": o.seed + len(trees)})
        said = lambda df: scoring.votes(df, [row, "label"], trees[-n:], classes).select(row, "label", "tree", "pred")
        numbered = F.col("tree") + (len(trees) - n)
        if tests is not None:
            told = joined(told, tests.append(said(test).withColumn("tree", numbered)))
        if not o.stopping:
            break
        # votes of the new trees on rows out of their bags
        if beside:
            votes = scoring.said(held, held.columns, trees[-n:], classes, "_said", "_weights").drop("_weights")
            curve, held = cast.append_beside(votes, "_said", len(trees) - n, n)
        else:
            curve = cast.append(said(known).join(bags.select(row, "tree"), [row, "tree"], "left_anti").withColumn("tree", numbered))
        trace = joined(trace, curve.withColumnRenamed("rows", "oob_rows"))
        stop = scoring.stopping_point(trace, o.slide, o.build).first()
        if stop is not None:
            trees = trees[: stop["stop_tree"] + 1]
            break
    return Model(replace(made, trees=tuple(trees)), imputed, trace, cast, told)


def joined(curve: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if curve is None else checkpoint(curve.unionByName(more))  # a row a tree


def fit_partitions(rows: DataFrame, row: str, attributes: list[str], classes: int, part: str, options: Options = Options(), discrete: dict[str, int] | None = None) -> dict[object, Model]:
    """A model for each value of part (not null), of that value's rows alone: ensembles to be combined by scoring.combine.

    All grow in one go: a value's trees are those whose bags hold its rows, and a level is one pass for all of them. Options
    are those of trees that don't depend on each other. A value's rows have their own medians and modes."""
    o, discrete = options, discrete or {}
    if o.boosting or o.smoteboost or o.ivoting or o.majority_ivoting or o.stopping or o.smote or o.balanced or o.majority_bagging:
        raise ValueError("partitions grow together only where trees don't depend on each other")
    known = rows.where(F.col("label").isNotNull() & F.col(part).isNotNull()).select(row, "label", F.col(part).alias("_part"), *attributes)
    sizes = {r["_part"]: r["n"] for r in known.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a model
    values = sorted(sizes)
    numbers, codes = [a for a in attributes if a not in discrete], [a for a in attributes if a in discrete]
    imputed = checkpoint(prep.imputed_by(known, ["_part"], numbers, codes))
    filled = known.join(F.broadcast(imputed.select("_part", *[F.col(a).alias(f"_i_{a}") for a in attributes])), "_part")  # a row a model
    number = F.create_map(*[F.lit(x) for p in enumerate(values) for x in reversed(p)])[F.col("_part")]
    filled = table(filled.select(row, "label", "_part", number.alias("_number"), *[F.coalesce(a, f"_i_{a}").alias(a) for a in attributes]), "partitions")
    if o.bagging is None:
        bags = filled.select(row, F.explode(F.sequence(F.col("_number") * o.trees, F.col("_number") * o.trees + (o.trees - 1))).alias("tree"), F.lit(1).cast("long").alias("weight"))
    else:
        placed = table(sampling.shuffled_places(filled.select(row, "_part"), row, "_part", o.seed), "partition-places")
        each = [sampling.bag(placed.where(F.col("_part") == F.lit(v)), row, sizes[v], o.trees, o.bagging, o.seed + i).withColumn("tree", F.col("tree") + i * o.trees) for i, v in enumerate(values)]
        bags = prep.union_all(each)
    masks = subspaces(rows.sparkSession, len(attributes), len(values) * o.trees, o.subspaces, o.seed)
    trees = grow(filled, row, attributes, classes, table(bags, "partition-bags"), len(values) * o.trees, discrete=discrete, masks=masks, **o.growth(len(attributes)))
    out = {}
    for i, v in enumerate(values):
        out[v] = Model(Ensemble(tuple(trees[i * o.trees : (i + 1) * o.trees]), classes, tuple(attributes), discrete), imputed.where(F.col("_part") == F.lit(v)).drop("_part"))
    return out


def partition_votes(models: dict[object, Model], rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ensemble (from 0, in the order of models), v0.., p0..: what each model's trees say of every row; for scoring.combine."""
    each = [m.tallies(rows, keep).withColumn("ensemble", F.lit(i)) for i, m in enumerate(models.values())]
    return prep.union_all(each)


def drawn_bags(rows: DataFrame, row: str, trees: int, o: Options, first: int = 0) -> DataFrame | None:
    """tree, row, weight of the trees (the first-th and on) of an ensemble; None: all rows once."""
    if o.balanced:
        quotas, n = clumps(rows, o.minority)
        each = [sampling.balanced_clump(rows.select(row, "label"), row, "label", quotas, (first + t) % n, o.seed + (first + t) // n).select(F.lit(t).alias("tree"), row, F.lit(1).alias("weight")) for t in range(trees)]
        return table(prep.union_all(each), "bags")
    if o.majority_bagging:
        return table(sampling.majority_bag(rows.select(row, "label"), row, "label", clumps(rows, o.minority)[0], trees, o.seed), "bags")
    if o.bagging is None:
        return None
    return table(sampling.bag(sampling.numbered(rows.select(row), row), row, rows.count(), trees, o.bagging, o.seed), "bags")


def clumps(rows: DataFrame, minority: Mapping[int, float]) -> tuple[dict[int, int], int]:
    """Rows that each majority class gives to a balanced set, and how many sets there are."""
    plan = sampling.clump_plan(rows.groupBy("label").agg(F.count("*").alias("n")), dict(minority)).collect()  # a row a class
    return {r["label"]: int(r["quota"]) for r in plan if not r["minority"]}, max([1, *(int(r["clumps"] or 1) for r in plan)])


def subspaces(spark, attributes: int, trees: int, percent: int | None, seed: int) -> dict[int, list[int]] | None:
    if percent is None:
        return None
    keep = attributes * percent // 100
    if not keep:
        raise ValueError("a subspace has an attribute at least")
    out: dict[int, list[int]] = {}
    for r in sampling.attribute_sample(spark.range(trees).withColumnRenamed("id", "tree"), "tree", attributes, keep, seed).collect():  # trees x attributes at most
        out.setdefault(r["tree"], []).append(r["attribute"])
    return out


def with_synthetic(rows: DataFrame, row: str, attributes: list[str], discrete: dict[str, int], o: Options, closed: bool) -> DataFrame:
    """rows and the synthetic ones that bring each minority class to its share; their row keys are below 0."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    missing = {r["label"]: r["missing"] for r in sampling.smote_deficits(counts, dict(o.minority)).collect() if r["missing"] > 0}  # a row a class
    if not missing:
        return rows
    made = sampling.smote_classes(rows, row, attributes, missing, o.neighbours, o.distance, list(discrete), closed, o.seed)
    return rows.unionByName(made.select((-1 - F.col("copy")).cast(rows.schema[row].dataType).alias(row), "label", *attributes))


def tested(model: Model, rows: DataFrame, row: str) -> dict[str, DataFrame]:
    """predictions, confusion, measures (each class, overall and the mean of the classes) and trees (each one's accuracy) of
    rows with labels; rows without one are predicted only."""
    out = table(model.transform(rows, [row, "label"]), "tested")
    known = out.where("label is not null")
    each = model.votes(rows.where("label is not null"), [row, "label"]).groupBy("tree").agg(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))
    return {"predictions": out, "confusion": metrics.confusion(known), "measures": metrics.measures(known, model.ensemble.classes), "trees": each}


def cross_validated(rows: DataFrame, row: str, attributes: list[str], classes: int, folds: int = 10, options: Options = Options(), discrete: dict[str, int] | None = None, repeats: int = 1) -> DataFrame:
    """iter, fold, row, label, v0.., p0.., pred of every labelled row by the model of the rows outside its fold.

    Folds are stratified; repeats deals them anew (5 repeats of 2 folds: 5x2). Where trees don't depend on each other,
    those of all folds grow together, each fold's bags holding none of its rows; else, and where values are missing (which
    each fold replaces by those of its own training rows), the folds are trained in turn."""
    o = options
    known = rows.where("label is not null").select(row, "label", *attributes)
    out = []
    for i in range(repeats):
        dealt = table(sampling.stratified_folds(known, row, "label", folds, o.seed + i), "folds")
        together = not (o.boosting or o.smoteboost or o.ivoting or o.majority_ivoting or o.stopping or o.smote or o.balanced or o.majority_bagging or o.subspaces)
        keep = ["fold", row, "label"]
        holes = F.greatest(F.lit(0), *[F.max(F.when(F.col(a).isNull() | F.isnan(F.col(a).cast("double")), 1).otherwise(0)) for a in attributes])
        if together and not dealt.agg(holes.alias("any")).first()["any"]:
            if o.trees == 1 and o.bagging is None and not o.subsample and o.depth != 0:
                # a tree a fold: histograms of a fold's training rows are those of all rows less its own
                grown = grow(dealt, row, attributes, classes, trees=folds, discrete=discrete, folds="fold", **o.growth(len(attributes)))
                # a row's only vote is that of its own fold's tree
                cast = scoring.votes(dealt, keep, grown, classes).where(F.col("tree") == F.col("fold"))
                cast = cast.select(*keep, *[F.when(F.col("pred") == k, 1.0).otherwise(0.0).alias(f"v{k}") for k in range(classes)], *[F.col("probs")[k].alias(f"p{k}") for k in range(classes)])
                out.append(predicted(cast, classes).withColumn("iter", F.lit(i)))
                continue
            filled = dealt
            bags = []
            for f in range(folds):
                outside = dealt.where(F.col("fold") != f).select(row)
                if o.bagging is None:
                    bags.append(outside.select(F.explode(F.sequence(F.lit(f * o.trees), F.lit(f * o.trees + o.trees - 1))).alias("tree"), row, F.lit(1).cast("long").alias("weight")))
                else:
                    bag = sampling.bag(sampling.numbered(outside, row), row, outside.count(), o.trees, o.bagging, o.seed + i * folds + f)
                    bags.append(bag.select((F.col("tree") + f * o.trees).alias("tree"), row, "weight"))
            grown = grow(filled, row, attributes, classes, table(prep.union_all(bags), "fold-bags"), folds * o.trees, discrete=discrete, **o.growth(len(attributes)))
            # of a row's votes those of its own fold's trees
            cast = scoring.votes(filled, keep, grown, classes).where(F.floor(F.col("tree") / o.trees) == F.col("fold"))
            found = predicted(scoring.tally(cast, keep, classes), classes)
        else:
            models = [fit(dealt.where(F.col("fold") != f), row, attributes, classes, replace(o, seed=o.seed + i * folds + f), discrete) for f in range(folds)]
            found = prep.union_all([m.transform(dealt.where(F.col("fold") == f), keep) for f, m in enumerate(models)])
        out.append(found.withColumn("iter", F.lit(i)))
    return prep.union_all(out)


def outside_fold(rows: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a fold of rows(fold)."""
    return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
