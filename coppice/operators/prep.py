"""Profile, impute, encode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.scalars import lower_median, smallest_mode


def profile(df: DataFrame, columns: list[str], threshold: int = 10) -> DataFrame:
    """attribute, n, missing, numeric, distinct_values, kind: continuous (numeric, more than threshold values), mixed
    (numbers and strings) or discrete. One pass of aggregates, no row leaves its task uncounted."""
    stats = []
    for c in columns:
        number = F.expr(f"try_cast(cast({c} as string) as double)")
        stats.append(F.struct(F.lit(c).alias("attribute"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count(number).alias("numeric"), F.count_distinct(F.col(c)).alias("distinct_values")).alias(c))
    rows = df.agg(*stats).select(F.explode(F.array(*columns)).alias("p")).select("p.*")
    present = F.col("n") - F.col("missing")
    kind = F.when((F.col("numeric") == present) & (F.col("distinct_values") > threshold), "continuous").when((F.col("numeric") > 0) & (F.col("numeric") < present), "mixed").otherwise("discrete")
    return rows.withColumn("kind", kind)


def imputed_values(df: DataFrame, continuous: list[str], discrete: list[str]) -> DataFrame:
    """One row: the lower median of each continuous and the smallest mode of each discrete attribute."""
    return df.agg(*[lower_median(c).alias(c) for c in continuous], *[smallest_mode(c).alias(c) for c in discrete])


def imputed_by(df: DataFrame, by: list[str], continuous: list[str], discrete: list[str]) -> DataFrame:
    """The same of each group of rows: a row a group."""
    return df.groupBy(*by).agg(*[lower_median(c).alias(c) for c in continuous], *[smallest_mode(c).alias(c) for c in discrete])


def impute(df: DataFrame, values: DataFrame) -> DataFrame:
    """Nulls replaced by the training rows' values (one row, broadcast)."""
    named = values.select(*[F.col(c).alias(f"_{c}") for c in values.columns])
    both = df.crossJoin(F.broadcast(named))
    return both.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in values.columns else F.col(c) for c in df.columns])


def encode(df: DataFrame, column: str, domain: list[str], out: str) -> DataFrame:
    """Position in the declared domain, -1 where absent."""
    at = F.array_position(F.array(*[F.lit(x) for x in domain]), F.col(column)) - 1
    return df.withColumn(out, F.coalesce(at, F.lit(-1)).cast("int"))


def value_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of any type and their codes from 0, numbered by ranges: cut at some of the values, which
    decide how the work is dealt alone."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    cuts = sorted(r["value"] for r in values.orderBy(F.xxhash64("value"), "value").limit(63).collect())
    part = reduce(lambda s, c: s + F.when(F.col("value") >= F.lit(c), 1).otherwise(0), cuts, F.lit(0))
    values = values.withColumn("_part", part)
    sizes = values.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # 64 rows
    numbered = values.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("value")))
    return numbered.join(F.broadcast(sizes), "_part").select("value", (F.col("_before") + F.col("_at") - 1).alias("code"))


def long_rows(df: DataFrame, row: str, label: str, attributes: list[str]) -> DataFrame:
    """row, label, attribute index, value: one row for each attribute."""
    parts = F.array(*[F.struct(F.lit(i).alias("attribute"), F.col(c).cast("double").alias("value")) for i, c in enumerate(attributes)])
    return df.select(F.col(row), F.col(label), F.explode(parts).alias("x")).select(row, label, "x.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
