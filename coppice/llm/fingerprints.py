"""Operator 4: document fingerprints by consistent weighted sampling.

A document's weighted terms are its words and their counts. For each of SAMPLES samples every term has gamma variates r
and c and a uniform b, hashes of the term and the sample alone; with weight w it draws t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1), and the term of the smallest a is the sample, together with its t. Two documents share a
sample with a probability that equals their generalised Jaccard similarity, sum of min over sum of max of the weights.

All of it is built-in expressions: one shuffle, the only one, brings neighbouring documents together, and all that
follows (counts of words, samples, minima, neighbours) is grouped within that partitioning. What is known of a document
besides its words comes along as one more row of it, with an empty word.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 48
#: Samples that one exploded row computes.
LANES = 4
TERM_BITS = 26
#: Ranges of documents (and tasks) for each shuffle partition: the counts of a range's words are to fit a task's memory.
PIECES = 4


def uniform(h: Column, part: int) -> Column:
    """In (0, 1), from the upper or lower 32 bits of a hash."""
    bits = F.shiftrightunsigned(h, 32) if part else h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return (bits + 0.5) / F.lit(float(1 << 32))


def samples(terms: DataFrame, keys: list[str], term: str, weights: list[str], note: str | None = None) -> DataFrame:
    """keys, and per weight column w an array w of SAMPLES ids (int) of consistent weighted samples.

    terms: one row for each key and term (a long hash), with weights of one or more bags of the key; a weight of 0 or
    null, or a null term, leaves the term out. An empty bag's samples are null. note: a string column, '' in rows with a
    term; a key's largest is kept, and keys without any term then have a row too.
    """
    logs = [F.when(F.col(term).isNotNull() & (F.col(w) > 0), F.log(F.col(w).cast("double"))).alias(f"l_{w}") for w in weights]
    said = F.col(note) if note else F.lit("")
    rows = terms.select(*keys, said.alias("said"), F.col(term).alias("term"), *logs).withColumn("lane", F.explode(F.array(*[F.lit(i) for i in range(0, SAMPLES, LANES)])))
    lane = [*keys, "said", "lane", *[f"l_{w}" for w in weights]]
    each = range(LANES)
    # One projection a step, so that nothing is computed twice.
    rows = rows.select(*lane, *[F.xxhash64("term", F.col("lane") + i).alias(f"h{i}") for i in each])
    rows = rows.select(*lane, *[f"h{i}" for i in each], *[F.xxhash64(f"h{i}", F.lit(1)).alias(f"g{i}") for i in each], *[F.xxhash64(f"h{i}", F.lit(2)).alias(f"k{i}") for i in each])
    gamma = lambda h: -F.log(uniform(F.col(h), 0) * uniform(F.col(h), 1))
    rows = rows.select(*lane, *[x for i in each for x in (f"h{i}", gamma(f"h{i}").alias(f"r{i}"), F.log(gamma(f"g{i}")).alias(f"c{i}"), uniform(F.col(f"k{i}"), 0).alias(f"b{i}"))])
    rows = rows.select("*", *[F.floor(F.col(f"l_{w}") / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t_{w}{i}") for w in weights for i in each])
    aggregates = []
    for w in weights:
        for i in each:
            t = F.col(f"t_{w}{i}")
            a = F.col(f"c{i}") - F.col(f"r{i}") * (t - F.col(f"b{i}") + 1)
            # a in the upper bits, the sampled term and its t in the lower ones: the minimum carries both
            packed = F.shiftleft(((a + 512) * F.lit(float(1 << 27))).cast("long"), TERM_BITS).bitwiseOR(F.xxhash64(F.col(f"h{i}"), t).bitwiseAND(F.lit((1 << TERM_BITS) - 1).cast("long")))
            aggregates.append(F.min(packed).alias(f"{w}{i}"))
    lanes = rows.groupBy(*keys, "said", "lane").agg(*aggregates)
    low = lambda x: x.bitwiseAND(F.lit((1 << TERM_BITS) - 1).cast("long")).cast("int")
    listed = F.when(F.col("said") == "", F.struct("lane", *[F.array(*[low(F.col(f"{w}{i}")) for i in range(LANES)]).alias(w) for w in weights]))
    listed = lanes.groupBy(*keys).agg(F.sort_array(F.collect_list(listed)).alias("all"), F.max("said").alias("said"))
    none = F.array_repeat(F.lit(None).cast("int"), SAMPLES)
    return listed.select(*keys, *([F.col("said").alias(note)] if note else []), *[F.when(F.size("all") > 0, F.flatten(F.col(f"all.{w}"))).otherwise(none).alias(w) for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints; two empty bags are alike."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SAMPLES))


def text_of(samples: Column) -> Column:
    """A fingerprint as a string: 7 hexadecimal digits a sample; those of an empty bag are '-'."""
    return F.array_join(F.transform(samples, lambda x: F.coalesce(F.lpad(F.hex(x), 7, "0"), F.lit("-"))), "")


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """bucket, at, doc_id, text, next, extra of docs(doc_id, text): next is the text that follows in descending doc_id.

    Buckets are ranges of doc_id from approximate quantiles. The first rows of a bucket are also sent, as extra rows,
    to the bucket before it (those of the first to the last), so that one shuffle by bucket gives every row its
    successor. Rows of one doc_id are ordered by their text's hash; null ids come last.
    """
    shares = [i / partitions for i in range(1, partitions)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id"), shares, 10 * max(partitions, 1000))).first()[0] if shares else None
    splits = [-float("inf"), *sorted({float(x) for x in cuts or []}), float("inf")]
    rows = docs.withColumn("_key", -F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
    splits = sorted({-x for x in splits})
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(rows).withColumn("bucket", F.col("_bucket").cast("int")).drop("_bucket", "_key")
    else:  # no row has an id
        rows = rows.withColumn("bucket", F.lit(0)).drop("_key")
    # A row a bucket: its largest id, and the bucket that ends before it.
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    before = [(b, top, tops[i - 1][0]) for i, (b, top) in enumerate(tops)]
    tops_df = docs.sparkSession.createDataFrame(before, "bucket int, top long, sent int")
    both = rows.join(F.broadcast(tops_df), "bucket")  # as many rows as buckets
    targets = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct("bucket", F.lit(False).alias("extra")), F.struct(F.col("sent").alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("extra"))))
    both = both.select("doc_id", "text", F.explode(targets).alias("to")).select("doc_id", "text", "to.*")
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    both = both.repartition(partitions, "bucket")  # a number of its own isn't coalesced: the grouping after it works on small ranges
    return both.select("bucket", F.row_number().over(order).alias("at"), "doc_id", "text", "extra", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text, in descending doc_id; after the last comes the first. A null text is empty. Words are cut at
    space and 0x09-0x0D; a text without words has the fingerprint of the empty bag, which is like itself and nothing
    else. A null doc_id comes last; repeated rows follow each other. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = PIECES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, partitions).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("note", F.concat("n_chars", F.lit(":"), F.sha2("edited", 256)))

    keys = ["bucket", "at", "doc_id", "extra"]
    bags = rows.select(*keys, "note", F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("text").alias("body")), F.struct(F.lit(0).alias("own"), F.col("edited").alias("body")))).alias("x"))
    # the space before a text makes its first word empty: the row that carries the note
    terms = bags.select(*keys, "note", "x.own", F.explode(F.split(F.concat(F.lit(" "), "x.body"), r"[\x20\x09-\x0D]+")).alias("word"))
    terms = terms.select(*keys, "own", F.when(F.col("word") == "", F.col("note")).otherwise("").alias("note"), F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    terms = terms.groupBy(*keys, "note", "term").agg(F.sum("own").alias("own"), F.sum(1 - F.col("own")).alias("edit"))
    found = samples(terms, keys, "term", ["own", "edit"], "note")

    order = Window.partitionBy("bucket").orderBy("at")
    found = found.withColumn("following", F.lead("own").over(order)).where("not extra")
    note = F.split("note", ":")
    return found.select("doc_id", note[0].cast("long").alias("n_chars"), note[1].alias("edited_sha256"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
