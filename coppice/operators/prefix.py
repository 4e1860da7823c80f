"""Running sums along one order in levels, so that no task gets a whole order, however many rows it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.plans.materialize import table

#: Rows of a part, which are scanned together, are 2 ** PART_BITS at most. A partition's rows have 33 bits of their numbers.
PART_BITS, ROW_BITS = 15, 33


def ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, written once along the order, with _pos (ascends along it), _part and _task (neighbouring rows; parts of a task).

    Rows are dealt by ranges of the order, of equal rows too, so that no value's rows have to be in one task."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    along = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    out = table(along.withColumn("_pos", F.monotonically_increasing_id()), "ordered")
    return out.withColumns({"_part": F.shiftright("_pos", PART_BITS), "_task": F.shiftright("_pos", ROW_BITS)})


def running(rows: DataFrame, keys: list[str], order: str, sums: list[str], ties: list[str] | None = None) -> DataFrame:
    """Adds for each column c of sums c_upto (over rows of the keys up to this one in the order, with it) and c_all (over
    all rows of the keys), and next, the next row's order (null for the last). ties: columns that order rows further.

    Three levels: the rows of a part, 2 ** PART_BITS at most; the parts of a task; the tasks. What a scan holds so grows with
    the cube root of the rows."""
    parts = ordered(rows, [*keys, order, *(ties or [])])
    own = [F.sum(c).alias(f"{c}_own") for c in sums]
    level = parts.groupBy(*keys, "_task", "_part").agg(*own, F.min(order).alias("_first"))
    task = level.groupBy(*keys, "_task").agg(*[F.sum(f"{c}_own").alias(f"{c}_own") for c in sums], F.min("_first").alias("_first"))
    before = lambda c, w: F.sum(f"{c}_own").over(w) - F.col(f"{c}_own")
    along, everything = Window.partitionBy(*keys).orderBy("_task"), Window.partitionBy(*keys)  # a row a task
    task = task.select(*keys, "_task", *[before(c, along).alias(f"{c}_tasks") for c in sums], *[F.sum(f"{c}_own").over(everything).alias(f"{c}_all") for c in sums], F.lead("_first").over(along).alias("_later"))
    inner = Window.partitionBy(*keys, "_task").orderBy("_part")  # a row a part
    level = level.select(*keys, "_task", "_part", *[before(c, inner).alias(f"{c}_parts") for c in sums], F.lead("_first").over(inner).alias("_soon")).join(task, [*keys, "_task"])
    level = level.select(*keys, "_part", *[(F.col(f"{c}_tasks") + F.col(f"{c}_parts")).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums], F.coalesce("_soon", "_later").alias("_following"))
    within = Window.partitionBy(*keys, "_part").orderBy("_pos")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("*", F.lead(order).over(within).alias("_lead"), *[F.sum(c).over(upto).alias(f"{c}_in") for c in sums])
    both = parts.join(level, [*keys, "_part"])
    return both.select(*rows.columns, *[(F.col(f"{c}_before") + F.col(f"{c}_in")).alias(f"{c}_upto") for c in sums], *[f"{c}_all" for c in sums], F.coalesce("_lead", "_following").alias("next"))
