"""Operator 5: repeated runs of lines are deleted where they occur again.

Lines without words are left aside. A window is a run of lines with words of WINDOW words or more that would have fewer
without its first or without its last line. Every run of WINDOW words or more consists of such windows, all of them
within the run: so a line lies in a run that occurred before exactly if it lies in a window that did, and windows are
joined with their first occurrence alone (by doc_id, row, line), wherever the lines around them first occurred.

Choosing only the minima of windows and extending their matches, as winnowing does, would need every earlier occurrence
of a line as a partner: with one partner a run is lost whose lines first occurred elsewhere. As windows are hashed whole
instead, a match can't be extended: the windows to both sides are matches themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.rows import mark, same
from coppice.plans.materialize import table

#: Words of the shortest run that is deleted.
WINDOW = 8
#: Copies of a first occurrence, so that a very frequent window's rows are joined in several tasks.
SALTS = 8


def lines_of(text: Column) -> Column:
    """line (from 0), end (the last line before the next one with words), h (hash), words of a text's lines with words."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    return F.filter(lines, lambda x: x["words"] > 0)


def windows_of(rows: DataFrame) -> DataFrame:
    """doc_id, mark, line, end (last line), window (hash of its lines with words) of each window of rows(doc_id, mark, text)."""
    rows = rows.select("doc_id", "mark", lines_of(F.col("text")).alias("l"), F.size(F.split("text", "\n")).alias("all"))
    # a line has a word at least: a window that starts here has WINDOW lines at most, and one more tells where the last one's blank lines end
    rows = rows.select("doc_id", "mark", "all", F.explode(F.transform("l", lambda x, i: F.slice("l", i + 1, F.lit(WINDOW + 1)))).alias("ahead"))
    upto = F.aggregate(F.slice("ahead", 1, WINDOW), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["words"])))
    rows = rows.withColumn("words", F.get("ahead", F.lit(0))["words"]).withColumn("upto", upto)  # words of the first 0, 1, 2 ... lines
    ends = F.expr(f"filter(sequence(1, size(upto) - 1), k -> upto[k] >= {WINDOW} and (upto[k - 1] < {WINDOW} or upto[k] - words < {WINDOW}))")
    # with lines as long as this one and the next, only the line itself
    alone = (F.col("words") >= WINDOW) & (F.coalesce(F.get("ahead", F.lit(1))["words"], F.lit(WINDOW)) >= WINDOW)
    rows = rows.withColumn("k", F.explode(F.when(alone, F.array(F.lit(1))).otherwise(ends)))
    return rows.select("doc_id", "mark", F.expr("ahead[0].line").alias("line"), F.expr("coalesce(get(ahead, k).line, all) - 1").alias("end"), F.xxhash64(F.expr("transform(slice(ahead, 1, k), x -> x.h)")).alias("window"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """doc_id, mark, gone (line / 64 -> bits of the lines to delete) of rows(doc_id, mark, text) with such lines."""
    found = table(windows_of(rows), "lines-windows")
    # nulls last, as places are compared
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line")
    first = found.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "line"), F.lit(SALTS)).cast("int"))
    both = later.join(first, ["window", "salt"]).where(~place.eqNullSafe(F.col("first")))
    lines = both.select("doc_id", "mark", F.explode(F.sequence("line", "end")).alias("line"))
    words = lines.groupBy("doc_id", "mark", F.shiftright("line", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, line & 63)")).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines, n_removed for each row of docs.

    The first occurrence of a run stays: the least doc_id (null last), then the least hash of the text, then line. Every
    run of WINDOW words or more that began before is deleted, whole. Lines without words don't count: runs that differ in
    them are equal, and such lines go with the line with words before them. A null text is one empty line. Of rows that
    repeat doc_id and text all but one (any of them) are repeats: with WINDOW words or more they lose all lines with
    words. Other columns are ignored; no rows give none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", mark(F.col("text")))
    gone = repeated_lines(rows)
    # null ids need null-safe keys
    out = rows.join(gone.select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), "gone"), same([(F.col("doc_id"), F.col("g_id")), (F.col("mark"), F.col("g_mark"))]), "left")
    out = out.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.lit(0))))
    split = F.split("text", "\n")
    words = F.expr("aggregate(full, 0, (s, x) -> s + x.words)")
    out = out.withColumn("full", F.when(F.col("copy") > 1, lines_of(F.col("text"))))
    kept = F.when((F.col("copy") > 1) & (words >= WINDOW), F.slice(split, F.lit(1), F.expr("full[0].line")))
    kept = kept.when(F.col("gone").isNull(), split)
    kept = kept.otherwise(F.expr("filter(split(text, '\\n'), (x, i) -> (coalesce(try_element_at(gone, shiftright(i, 6)), 0L) & shiftleft(1L, i & 63)) = 0)"))
    out = out.select("doc_id", F.size(split).alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"))
