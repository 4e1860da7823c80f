"""Operator 8: shards by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight, u a hash of the document's
key and the child's name, and the smallest draw wins: children win in proportion to their weights, and a change of one
weight moves rows only into or out of that child's subtree. Everything is built-in expressions on one row; only small
rows (no texts) are shuffled, for the slot numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.rows import apart
from coppice.plans.materialize import table

#: Parts of a shard that are numbered separately: a part's rows meet in one task, and the driver's plan has none of them.
PARTS = 1024
#: Bound of the tree that is part of the plan.
MOST_SHARDS = 20_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = 2, per_rack: int = 5) -> list[Leaf]:
    """Shards 0.. in racks of per_rack and regions of racks, all of weight 1."""
    return [Leaf(f"r{i // (racks * per_rack)}", f"k{i // per_rack}", i) for i in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, numbered next, as a region of its own: no existing subtree's weight changes, so that rows move
    into the new shard and nowhere else."""
    number = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(f"grown{number}", f"grown{number}", number, weight)]


def _level(tree: list[Leaf], parent, child) -> Column:
    """Literal map from a parent's name to its children's names and weights."""
    children: dict[str, dict[str, float]] = {}
    for x in tree:
        if x.weight <= 0:
            raise ValueError("weights must be positive")
        own = children.setdefault(parent(x), {})
        own[child(x)] = own.get(child(x), 0.0) + x.weight
    pairs = [y for name, own in children.items() for y in (F.lit(name), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in own.items()]))]
    return F.create_map(*pairs)


def _draw(key: Column, children: Column, level: str) -> Column:
    """The child of least -ln(u) / weight; u comes from the md5 of level, child and key, so that any program draws alike."""

    def score(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(level), c["name"], key)), 1, 13), 16, 10).cast("long")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(1 << 52))) / c["weight"]).alias("score"), c["name"].alias("name"))

    return F.array_min(F.transform(children, score))["name"]


def descend(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """Adds ``out`` (int): the shard of each row's key; the key (null: a key of its own) and the tree alone decide."""
    if len(tree) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards: the tree is part of the plan")
    region, rack, name = apart(df, "region", "rack", "name")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    df = df.withColumn(region, _draw(text, F.element_at(_level(tree, lambda x: "", lambda x: x.region), F.lit("")), "region"))
    df = df.withColumn(rack, _draw(text, F.element_at(_level(tree, lambda x: x.region, lambda x: x.rack), F.col(region)), "rack"))
    df = df.withColumn(name, _draw(text, F.element_at(_level(tree, lambda x: x.rack, lambda x: str(x.shard)), F.col(rack)), "shard"))
    return df.withColumn(out, F.col(name).cast("int")).drop(region, rack, name)


def shard(docs: DataFrame, tree: list[Leaf], doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard for each row of docs; with whole, all columns of
    docs too (those called like one of these are replaced, but for doc_id).

    size is the text's UTF-8 bytes plus 16 (null text: 16, crc32 of no bytes). slot numbers a shard's rows without
    gaps from 0: by part (a hash of key and text), then doc_id, then text_crc32; it takes no order from the input.
    grown_shard is the shard with one more (see grow). A null doc_id is one more key. Repeated rows go to one shard
    and get slots of their own. Other columns are ignored; no rows give none.
    """
    made = ["size", "text_crc32", "shard", "slot", "grown_shard", "law"]
    others = [c for c in docs.columns if c.lower() not in {*made, doc_id.lower()}] if whole else []
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), *([F.struct(*[F.col(c) for c in others]).alias("others")] if others else []))
    rows = descend(descend(rows, "doc_id", tree, "shard"), "doc_id", grow(tree), "grown_shard")
    rows = table(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("part")), F.lit(PARTS)).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("part")
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", (F.sum("n").over(before) - F.col("n")).alias("before"))
    at = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(at) - 1).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", *[F.col(f"others.{c}").alias(c) for c in others], "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).alias("slot"), "grown_shard")
