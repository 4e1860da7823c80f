"""Operator 6: sources mixed to target weights by systematic sampling.

Within a source every document expects target / source_size copies. The prefix sums of the expectation, plus one random
offset of the source, cross an integer boundary once for each copy. Documents are taken in order of size, so that the
words taken follow the target closely. The prefix sum is two-level: counts of small ranges of the order (a source's
documents of about one size, in parts by doc_id), then positions within a range, so that no source's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.rows import apart, mark, same
from coppice.plans.materialize import table

#: Largest number of expected copies of a document.
MOST = 3
#: Parts of the documents of about one size: a part's rows meet in one task.
PARTS = 128


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Column) -> DataFrame:
    """source, source_size -> with target: shares of all sizes by weight, none above MOST times its source's size.

    The excess of the sources that stop is reshared by weight: with sources in order of cap / weight, a source stops
    when its cap is at most its share of what those before it leave. One row a source.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = sizes.withColumn("weight", weights).withColumn("cap", MOST * F.col("source_size"))
    for name in ("cap", "weight"):
        rows = rows.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0)))
    left = F.sum("source_size").over(everything) - F.col("cap_before")
    open_weight = F.sum("weight").over(everything) - F.col("weight_before")
    rows = rows.withColumn("rate", left / open_weight).withColumn("stops", F.col("cap") * open_weight <= F.col("weight") * left)
    rows = rows.withColumn("at", F.row_number().over(order))
    first = F.min(F.when(~F.col("stops"), F.struct("at", "rate"))).over(everything)
    share = F.col("weight") * F.coalesce(first["rate"], F.lit(0.0))
    return rows.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share)).alias("target"))


def cycle(n: int = 3) -> Column:
    """Weights 1 to n, repeating over the sources by code point, null last."""
    return (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n + 1


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1): a portable hash of its name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs; taken = size * copies.

    size counts the text's words (null: 0). A null source is a source, the last. Documents of one size are ordered by
    doc_id; repeated rows count each. A source without words has target 0 and takes nothing. Other columns are
    ignored. Reruns agree: the offset depends on the source's name and the seed alone.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.lit(0).cast("long").alias("mark"))
    return marked_mix(rows, seed).drop("mark")


def size_level(size: Column) -> Column:
    """Eight levels for each doubling of size."""
    return F.length(F.bin(size)) * 8 + F.expr("shiftright(size * 8, cast(length(bin(size)) as int) - 1) & 7").cast("int")


def marked_mix(rows: DataFrame, seed: int) -> DataFrame:
    """mix of rows(doc_id, source, size, mark); mark is kept. The order within a source is by size level, part, size,
    doc_id and mark, whatever the number of rows."""
    rows = table(rows, "mixing")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, cycle())
    key = F.pmod(F.lit(16807) * F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2147483647)), F.lit(2147483647))
    rows = rows.withColumn("level", size_level(F.col("size"))).withColumn("salt", key % PARTS)
    counts = rows.groupBy("source", "level", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("level", "salt")
    counts = counts.withColumn("before", F.sum("n").over(before) - F.col("n"))
    ranges = counts.alias("c").join(aims.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source"))).select("c.source", "level", "salt", "before", "source_size", "target")
    at = Window.partitionBy("source", "level", "salt").orderBy("size", "doc_id", "mark")
    rows = rows.withColumn("at", F.row_number().over(at))
    same = F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.level") == F.col("r.level")) & (F.col("d.salt") == F.col("r.salt"))
    rows = rows.alias("d").join(ranges.alias("r"), same).select("d.doc_id", "d.source", "d.size", "d.mark", "r.source_size", "r.target", (F.col("r.before") + F.col("d.at")).alias("rank"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    shift = offset(F.col("source"), seed)
    copies = F.floor(F.col("rank") * rate + shift) - F.floor((F.col("rank") - 1) * rate + shift)
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "mark")


def repeated(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Rows of docs(doc_id, text, source) as often as their mix takes them; columns stay.

    Rows are told apart by doc_id, source and a hash of the text, nulls included; of rows that agree in these the mix may
    take some more often than others, and any of them are.
    """
    id_, mark_, n, times = apart(docs, "id", "mark", "n", "times")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), mark_: mark(F.col("text"))})
    mixed = marked_mix(keyed.select(F.col(id_).alias("doc_id"), "source", words(F.col("text")).alias("size"), F.col(mark_).alias("mark")), seed)
    # alike rows share the copies of all of them: as evenly as they go
    alike = mixed.groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    alike = alike.select(*[F.col(c).alias(f"r_{c}") for c in alike.columns])
    both = keyed.alias("d").join(alike.alias("r"), same([(F.col(f"d.{a}"), F.col(f"r.r_{b}")) for a, b in ((id_, "doc_id"), ("source", "source"), (mark_, "mark"))]))
    both = both.withColumn(n, F.row_number().over(Window.partitionBy(f"d.{id_}", "d.source", f"d.{mark_}").orderBy(F.lit(0))))
    share = F.floor(F.col("r_copies") * F.col(n) / F.col("r_rows")) - F.floor(F.col("r_copies") * (F.col(n) - 1) / F.col("r_rows"))
    both = both.withColumn(times, share.cast("int")).where(F.col(times) > 0)
    return both.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"d.{c}") for c in docs.columns])
