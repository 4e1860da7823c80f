"""Keys of rows for operators that return whole rows of documents: ids may be null or repeated, columns may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df is called so (capitals don't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mark(text: Column) -> Column:
    """A hash of a text; together with the doc_id it tells rows apart that share the id. Null and empty differ."""
    return F.xxhash64(text)


def place() -> Column:
    """struct(unknown, doc_id, mark): the order of rows by doc_id, those without one last, and by their text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")


def same(keys: list[tuple[Column, Column]]) -> Column:
    """All pairs of keys are equal, nulls too."""
    out = F.lit(True)
    for a, b in keys:
        out = out & a.eqNullSafe(b)
    return out
