"""Labelled tables from text: declared schemas, comma-separated rows, column and time selections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions.scalars import class_from_thresholds
from coppice.operators import prep
from coppice.plans.materialize import checkpoint

#: The kinds of an attribute, as declared.
KINDS = ("continuous", "discrete", "class", "exclude")


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    domain: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    attributes: tuple[Attribute, ...] = field(default=())

    @property
    def target(self) -> int | None:
        """The column typed class, else the last active column if it is discrete."""
        for i, a in enumerate(self.attributes):
            if a.kind == "class":
                return i
        active = [i for i, a in enumerate(self.attributes) if a.kind != "exclude"]
        return active[-1] if active and self.attributes[active[-1]].kind == "discrete" else None

    @property
    def struct(self) -> T.StructType:
        kinds = {"continuous": T.DoubleType()}
        return T.StructType([T.StructField(a.name, kinds.get(a.kind, T.StringType()), True, {"kind": a.kind, "domain": list(a.domain)}) for a in self.attributes])


def parse(text: str) -> Schema:
    """A schema of lines "name: kind[ values]"; # comments, blank lines and lines without a colon are passed over.

    Values are trimmed, an empty one is an error. Nameless attributes are called Atr1.. by position. If every name
    starts with its own column number, the numbers are dropped."""
    found = []
    for line in text.splitlines():
        head, colon, tail = line.split("#", 1)[0].strip().partition(":")
        if not colon:
            continue
        kind, _, values = tail.strip().rstrip(".").strip().partition(" ")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r} of attribute {head.strip()!r}")
        domain = tuple(v.strip() for v in values.split(",")) if values.strip() else ()
        if kind in ("discrete", "class") and (not domain or "" in domain):
            raise ValueError(f"attribute {head.strip()!r} has an empty value")
        found.append(Attribute(head.strip() or f"Atr{len(found) + 1}", kind, domain if kind in ("discrete", "class") else ()))
    parts = [re.fullmatch(r"(\d+)\s+(.+)", a.name) for a in found]
    if found and all(m and int(m[1]) == i + 1 for i, m in enumerate(parts)):
        found = [replace(a, name=m[2]) for a, m in zip(found, parts, strict=True)]
    return Schema(tuple(found))


def write(schema: Schema) -> str:
    return "".join(f"{a.name}: {a.kind}{' ' + ','.join(a.domain) if a.domain else ''}\n" for a in schema.attributes)


def ranges(text: str) -> list[int]:
    """The integers of "1-4,6"."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out.extend(range(int(low), int(high or low) + 1))
    return out


def as_ranges(numbers: list[int]) -> str:
    """The inverse of ranges."""
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def excluded(schema: Schema, steps: list[tuple[str, str]]) -> Schema:
    """include and exclude steps ("include", "1-4") in order; columns count from 1. A first include excludes the rest."""
    off = {i for i, a in enumerate(schema.attributes, 1) if a.kind == "exclude"}
    for at, (what, columns) in enumerate(steps):
        if what == "include":
            if at == 0:
                off = set(range(1, len(schema.attributes) + 1))
            off -= set(ranges(columns))
        else:
            off |= set(ranges(columns))
    return Schema(tuple(replace(a, kind="exclude") if i in off and a.kind != "class" else a for i, a in enumerate(schema.attributes, 1)))


def float_ranges(text: str) -> list[tuple[float, float]]:
    """The closed intervals of "0.5-1.5,3"; a single number is an interval of itself."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = re.fullmatch(r"(-?[\d.eE+]+)(-(-?[\d.eE+]+))?", part).group(1, 2, 3)
        out.append((float(low), float(high or low)))
    return out


def partitions(text: str) -> list[str]:
    """The data files that a partitions list names, separated by white space; an ensemble is made of each."""
    return text.split()


def read_partitions(spark: SparkSession, paths: list[str], schema: Schema) -> DataFrame:
    """read of each file, with its place in the list as partition."""
    frames = [read(spark, p, schema).withColumn("partition", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, frames)


def read(spark: SparkSession, paths: str | list[str], schema: Schema) -> DataFrame:
    """row_id, label (code of the class, null where unknown), and the active attributes, of comma-separated rows.

    ? is null; # lines and rows with too few fields are passed over, as are rows with a value outside its attribute's
    domain (see problems). A #labels line has to name the schema's attributes. Discrete values stay strings. row_id is
    unique, not gapless."""
    check_labels(spark.read.text(paths), schema)
    return read_lines(spark.read.text(paths).select(F.monotonically_increasing_id().alias("row_id"), "value"), schema)


def read_string(spark: SparkSession, text: str, schema: Schema) -> DataFrame:
    """read of rows that a string holds; row_id is the line's number."""
    lines = spark.createDataFrame(list(enumerate(text.splitlines())) or [(0, "")], "row_id long, value string")
    check_labels(lines, schema)
    return read_lines(lines, schema)


def read_lines(lines: DataFrame, schema: Schema) -> DataFrame:
    return _split(lines, schema).where(F.size("bad") == 0).select("row_id", *_columns(schema))


def check_labels(lines: DataFrame, schema: Schema) -> None:
    """Raises if a #labels line of any file names other attributes than the schema, or in another order; names may have their
    column number first."""
    listed = F.split(F.regexp_replace(F.trim("value"), "^#labels", ""), ",")
    named = F.transform(listed, lambda x: F.regexp_replace(F.trim(x), r"^\d+\s+", ""))
    wanted = [a.name for a in schema.attributes]
    labels = lines.where("startswith(trim(value), '#labels')").select(named.alias("named"))
    other = labels.where(F.col("named") != F.array(*[F.lit(x) for x in wanted])).limit(1).collect()
    if other:
        raise ValueError(f"a file's labels {other[0][0]} aren't the schema's {wanted}")


def comments(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The lines of data files as they are, and apart from them the comments."""
    lines = spark.read.text(paths)
    comment = F.trim("value").startswith("#")
    return lines.where(~comment), lines.where(comment)


def load_training(spark: SparkSession, paths: str | list[str], schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Encoded rows with their missing values replaced, and the row of values that replaced them."""
    rows = encoded(read(spark, paths, schema), schema)
    numbers, codes = kinds(schema)
    values = checkpoint(prep.imputed_values(rows, numbers, codes))
    return prep.impute(rows, values), values


def load_testing(spark: SparkSession, paths: str | list[str], schema: Schema, imputed: DataFrame) -> DataFrame:
    """Encoded rows, of unknown class too, with their missing values replaced as in training."""
    return prep.impute(encoded(read(spark, paths, schema), schema), imputed)


def kinds(schema: Schema) -> tuple[list[str], list[str]]:
    """The continuous and the discrete active attributes."""
    active = [a for i, a in enumerate(schema.attributes) if i != schema.target and a.kind != "exclude"]
    return [a.name for a in active if a.kind == "continuous"], [a.name for a in active if a.kind != "continuous"]


def domains(schema: Schema) -> dict[str, int]:
    """How many values each discrete active attribute has."""
    named = set(kinds(schema)[1])
    return {a.name: len(a.domain) for a in schema.attributes if a.name in named}


def encoded(rows: DataFrame, schema: Schema) -> DataFrame:
    """Discrete attributes as codes by their declared order; null stays null."""
    for a in schema.attributes:
        if a.name in kinds(schema)[1]:
            at = F.array_position(F.array(*[F.lit(x) for x in a.domain]), F.col(a.name)) - 1
            rows = rows.withColumn(a.name, F.nullif(at, F.lit(-1)).cast("int"))
    return rows


def mesh_rows(df: DataFrame, target: str, thresholds: list[float], association: dict[str, str], times: str | None = None) -> tuple[DataFrame, list[str]]:
    """row_id, timestep, mesh, point, label and attributes of a table of mesh variables (timestep, mesh, point and a column
    a variable), and the attributes' names.

    association: of each variable, what its values belong to (node or element). Attributes are the variables that belong
    to what the target does; the label is the target's class between thresholds. Only rows of the timesteps are kept."""
    names = [c for c, kind in association.items() if c != target and kind == association[target]]
    rows = at_times(df, times) if times else df
    # every mesh has to have all the attributes
    lacking = rows.groupBy("mesh").agg(*[F.count(c).alias(c) for c in names]).where(reduce(lambda a, c: a | (F.col(c) == 0), names, F.lit(False))).limit(1).collect() if names else []
    if lacking:
        raise ValueError(f"mesh {lacking[0]['mesh']} lacks an attribute")
    key = F.xxhash64("timestep", "mesh", "point").alias("row_id")
    return rows.select(key, "timestep", "mesh", "point", class_from_thresholds(F.col(target), thresholds).alias("label"), *names), names


def column_problems(df: DataFrame) -> DataFrame:
    """column, problem, n: what a column store would refuse: commas in strings, numbers that are none. Repeated names raise."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("a column's name is repeated")
    parts = []
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            parts.append(F.struct(F.lit(f.name).alias("column"), F.lit("comma").alias("problem"), F.count_if(F.contains(f.name, F.lit(","))).alias("n")))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            parts.append(F.struct(F.lit(f.name).alias("column"), F.lit("not a number").alias("problem"), F.count_if(F.isnan(f.name)).alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, problem string, n long")
    return df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).select(F.explode(F.array(*[f"_{i}" for i in range(len(parts))])).alias("p")).select("p.*").where("n > 0")


def problems(spark: SparkSession, paths: str | list[str], schema: Schema) -> DataFrame:
    """problem, n: what keeps rows out of read."""
    lines = spark.read.text(paths).select(F.monotonically_increasing_id().alias("row_id"), "value")
    return _split(lines, schema).select(F.explode("bad").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def _split(lines: DataFrame, schema: Schema) -> DataFrame:
    lines = lines.select("row_id", F.trim("value").alias("line"))
    lines = lines.where("line != '' and not startswith(line, '#')").select("row_id", F.transform(F.split("line", ","), lambda x: F.nullif(F.trim(x), F.lit("?"))).alias("f"))
    bad = [F.when(F.size("f") < len(schema.attributes), "fields")]
    for i, a in enumerate(schema.attributes):
        value = F.get("f", F.lit(i))
        if a.kind == "continuous":
            bad.append(F.when(value.isNotNull() & value.try_cast("double").isNull(), f"{a.name}: number"))
        elif a.kind == "discrete":
            bad.append(F.when(value.isNotNull() & ~value.isin(*a.domain), f"{a.name}: value"))
    return lines.withColumn("bad", F.array_compact(F.array(*bad)))


def _columns(schema: Schema) -> list:
    out = []
    for i, a in enumerate(schema.attributes):
        value = F.get("f", F.lit(i))
        if i == schema.target:
            out.append(F.nullif(F.array_position(F.array(*[F.lit(x) for x in a.domain]), value) - 1, F.lit(-1)).cast("int").alias("label"))
        elif a.kind == "continuous":
            out.append(value.cast("double").alias(a.name))
        elif a.kind != "exclude":
            out.append(value.alias(a.name))
    return out


def at_times(df: DataFrame, times: str, column: str = "timestep") -> DataFrame:
    """Rows of the timesteps "1-4,6"; a filter on a partition column prunes files."""
    return df.where(F.col(column).isin(*ranges(times)))
