"""Rows numbered along an order of the whole table, and cut into parts of bounded size that are neighbours in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.plans.materialize import table

#: Rows of a part are 2 ** PART_BITS at most.
PART_BITS = 15


def indexed(rows: DataFrame, order: list[str], name: str, bits: int = PART_BITS) -> DataFrame:
    """rows, written once in the order (nulls first), with pos (ascends along it; gapless within a part) and part.

    Rows are dealt by ranges of the order, of equal rows too, so that no key's rows have to be in one task."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    along = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    out = table(along.withColumn("pos", F.monotonically_increasing_id()), name)
    return out.withColumn("part", F.shiftright("pos", bits))


def tagged(column: Column) -> Column:
    """A key without nulls: null first, then the values in their bytewise order."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit(""))


def untagged(tag: Column, kind: str) -> Column:
    return F.when(tag != "", F.substring(tag, 2, 1 << 30)).cast(kind)
