"""Operator 11: Merkle manifest of a table, a tree for each group and one over the groups' roots.

Leaves are digests of rows; a group's leaves are numbered along its order. While several nodes remain, each ``fanout``
consecutive ones become the digest of their concatenated hex digests; the last run may be shorter, even of one node, and
is hashed as it is. Node ``place`` of ``level`` so covers the leaves from place * fanout ** level on.

The sorted leaves are cut into parts whose first numbers are known from counts. In a part a mountain range is kept as a
stack: a node that completes a run is carried into the next level, as a digit in a counter of base ``fanout``. Runs that a
part holds only in part stay on the stack: these peaks, a few for each level, are merged by the same carrying, in groups of
parts and groups of groups, until each group of the table has one range, whose short runs are closed then. A row's proof
takes the nodes of its own part and a few peaks and merged nodes: no row is joined with each of its levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.indexed import PART_BITS, indexed, tagged
from coppice.plans.materialize import checkpoint, table

#: Ranges that one task merges.
MERGED = 64

Place = tuple[int, int, str]  # level, place, digest
NODE = pa.schema([("tag", pa.string()), ("run", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("peak", pa.bool_())])
NODE_SQL = "tag string, run long, level int, place long, digest string, peak boolean"
PATH_SQL = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class Tree:
    """leaves: tag, pos, part, leaf, keep. runs: part, tag, run, start, size, total (a row a part and group). nodes: tag,
    run, level, place, digest, peak of the parts. above: the same of merges. roots: tag, root, total."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    above: DataFrame
    roots: DataFrame
    fanout: int


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(columns: list[Column]) -> Column:
    """Digest of the columns as text: - for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def carried(nodes: Iterable[Place], fanout: int) -> tuple[list[Place], list[Place]]:
    """Nodes that completed runs make, and the peaks that are left, of nodes that cover leaves without a gap, in order."""
    made: list[Place] = []
    peaks: list[Place] = []
    for level, place, own in nodes:
        peaks.append((level, place, own))
        while place % fanout == fanout - 1 and len(peaks) >= fanout and peaks[-fanout][:2] == (level, place - fanout + 1):
            level, place, own = level + 1, place // fanout, digest(p[2] for p in peaks[-fanout:])
            peaks[-fanout:] = [(level, place, own)]
            made.append(peaks[-1])
    return made, peaks


def closed(peaks: list[Place], total: int, fanout: int) -> tuple[list[Place], str]:
    """Nodes of the short runs above the peaks of all of total leaves, and the root."""
    made: list[Place] = []
    level, last = 0, []
    while True:
        last = [p for p in peaks if p[0] == level] + last
        if total == 1:
            return made, last[0][2]
        if last:
            last = [(level + 1, last[0][1] // fanout, digest(p[2] for p in last))]
            made += last
        total = -(-total // fanout)
        level += 1


def records(tag: str, run: int, made: list[Place], peaks: list[Place]) -> list[dict]:
    """made and peaks as rows; a node that is both is a row."""
    top = {p[:2] for p in peaks}
    below = [p for p in peaks if p[:2] not in {m[:2] for m in made}]
    return [{"tag": tag, "run": run, "level": p[0], "place": p[1], "digest": p[2], "peak": p[:2] in top} for p in (*made, *below)]


def spans(tags: list[str]) -> Iterator[tuple[str, int, int]]:
    """Runs of equal values: value, first, end."""
    first = 0
    for i in range(1, len(tags) + 1):
        if i == len(tags) or tags[i] != tags[first]:
            yield tags[first], first, i
            first = i


def build(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: dict[str, Column] | None = None, fanout: int = 2, bits: int = PART_BITS) -> Tree:
    """The trees of the groups of rows; leaves ascend by the order (nulls first), equal keys by their digest.

    keep: columns that stay with the leaves. No rows give no trees; a group of one row has its leaf as root. Rows that are
    equal throughout are leaves of their own."""
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    kept = F.struct(*[c.alias(n) for n, c in (keep or {}).items()], F.lit(0).alias("_"))
    keys = [f"o{i}" for i in range(len(order))]
    found = table(rows.select(tagged(group).alias("tag"), *[c.alias(k) for k, c in zip(keys, order, strict=True)], leaf.alias("leaf"), kept.alias("keep")), "manifest-rows")
    leaves = indexed(found, ["tag", *keys, "leaf"], "manifest-leaves", bits).select("tag", "pos", "part", "leaf", "keep")
    along, whole = Window.partitionBy("tag").orderBy("part"), Window.partitionBy("tag")  # a row a part
    runs = leaves.groupBy("part", "tag").agg(F.count("*").alias("size"))
    runs = checkpoint(runs.select("part", "tag", (F.row_number().over(along) - 1).cast("long").alias("run"), (F.sum("size").over(along) - F.col("size")).alias("start"), "size", F.sum("size").over(whole).alias("total")))

    def climb(own: pa.Table, starts: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        known = {r["tag"]: r for r in starts.to_pylist()}
        out, leaf = [], own["leaf"].to_pylist()
        for tag, a, z in spans(own["tag"].to_pylist()):
            made, peaks = carried(((0, known[tag]["start"] + i - a, leaf[i]) for i in range(a, z)), fanout)
            out += records(tag, known[tag]["run"], made, peaks)
        return pa.Table.from_pylist(out, schema=NODE)

    paired = leaves.select("part", "tag", "pos", "leaf").groupBy("part").cogroup(runs.groupBy("part"))
    nodes = table(paired.applyInArrow(climb, NODE_SQL), "manifest-nodes")

    def merge(rows: pa.Table) -> pa.Table:
        """A range of ranges; where it is all of its group, its short runs are closed and the root is a row of level -1."""
        rows = rows.to_pylist()
        tag, run, total = rows[0]["tag"], rows[0]["run"], rows[0]["total"]
        made, peaks = carried(sorted(((r["level"], r["place"], r["digest"]) for r in rows), key=lambda p: p[1] * fanout ** p[0]), fanout)
        out = records(tag, run, made, peaks)
        if total is not None:
            short, root = closed(peaks, total, fanout)
            out += [*records(tag, run, short, []), {"tag": tag, "run": total, "level": -1, "place": 0, "digest": root, "peak": False}]
        return pa.Table.from_pylist(out, schema=NODE)

    most = (runs.agg(F.max("run")).first()[0] or 0) + 1
    peaks, above = nodes.where("peak"), []
    while most > MERGED:
        most = -(-most // MERGED)
        level = peaks.select("tag", F.floor(F.col("run") / MERGED).alias("run"), "level", "place", "digest", F.lit(None).cast("long").alias("total"))
        above.append(table(level.groupBy("tag", "run").applyInArrow(merge, NODE_SQL), "manifest-merged"))
        peaks = above[-1].where("peak")
    totals = runs.select("tag", "total").distinct()
    last = peaks.select("tag", F.lit(0).cast("long").alias("run"), "level", "place", "digest").join(totals, "tag")
    above.append(table(last.groupBy("tag").applyInArrow(merge, NODE_SQL), "manifest-merged"))
    roots = above[-1].where("level = -1").select("tag", F.col("digest").alias("root"), F.col("run").alias("total"))
    merged = above[0]
    for x in above[1:]:
        merged = merged.unionByName(x)
    return Tree(leaves, runs, nodes, merged.where("level >= 0"), roots, fanout)


def needed(start: int, size: int, total: int, fanout: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes outside a part that the proofs of its leaves hold: those of the runs that its nodes
    are in, but for the nodes that the part completes itself."""
    low, high, end, level, width = start, start + size - 1, start + size, 0, 1
    while total > 1:
        first, last = low // fanout * fanout, min(high // fanout * fanout + fanout, total)
        own = range(-(-start // width), end // width)
        for place in range(first, last):
            if place not in own:
                yield level, place
        low, high, total, level, width = low // fanout, high // fanout, -(-total // fanout), level + 1, width * fanout


def proven(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """tag, leaf, keep, path, root (of the group), total: a row for each leaf; path is the siblings' concatenated digests
    before and after the row's node, level by level.

    above: tag, path, root: what follows the group's root on the way to a root over all groups; its path is appended and
    top is that root. Else top is the group's root."""
    fanout = tree.fanout

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["part"], r["tag"], level, place) for r in batch.to_pylist() for level, place in needed(r["start"], r["size"], r["total"], fanout)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["part", "tag", "level", "place"])

    wanted = tree.runs.mapInArrow(ask, "part long, tag string, level int, place long")
    # nodes of merges that stayed peaks of a range were rows before
    there = tree.nodes.where("peak").unionByName(tree.above).groupBy("tag", "level", "place").agg(F.first("digest").alias("digest"))
    near = wanted.join(there, ["tag", "level", "place"]).groupBy("part", "tag").agg(F.collect_list(F.struct("level", "place", "digest")).alias("near"))  # a few a level
    given = tree.runs.join(near, ["part", "tag"], "left").join(tree.roots.select("tag", "root"), "tag")
    if above is None:
        given = given.select("*", F.expr(f"cast(array() as {PATH_SQL})").alias("after"), F.col("root").alias("top"))
    else:
        given = given.join(above.select("tag", F.col("path").alias("after"), F.col("top")), "tag")
    given = given.select("part", "tag", "start", "total", "near", "root", "after", "top")
    keep = tree.leaves.schema["keep"].dataType.simpleString()

    def prove(own: pa.Table, given: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        known = {r["tag"]: r for r in given.to_pylist()}
        leaf, paths, roots, totals, tops = own["leaf"].to_pylist(), [], [], [], []
        for tag, a, z in spans(own["tag"].to_pylist()):
            r = known[tag]
            start, rest = r["start"], r["after"]
            made, _ = carried(((0, start + i - a, leaf[i]) for i in range(a, z)), fanout)
            node = {(level, place): own for level, place, own in made} | {(x["level"], x["place"]): x["digest"] for x in r["near"] or ()} | {(0, start + i - a): leaf[i] for i in range(a, z)}
            for i in range(start, start + z - a):
                path, level, total = [], 0, r["total"]
                while total > 1:
                    first = i // fanout * fanout
                    end = min(first + fanout, total)
                    path.append({"before": "".join([node[level, p] for p in range(first, i)]), "after": "".join([node[level, p] for p in range(i + 1, end)])})
                    i, total, level = i // fanout, -(-total // fanout), level + 1
                paths.append(path + rest)
            roots += [r["root"]] * (z - a)
            totals += [r["total"]] * (z - a)
            tops += [r["top"]] * (z - a)
        path = pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table({"tag": own["tag"], "leaf": own["leaf"], "keep": own["keep"], "path": path, "root": pa.array(roots, pa.string()), "total": pa.array(totals, pa.int64()), "top": pa.array(tops, pa.string())})

    both = tree.leaves.groupBy("part").cogroup(given.groupBy("part"))
    return both.applyInArrow(prove, f"tag string, leaf string, keep {keep}, path {PATH_SQL}, root string, total long, top string")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda own, at: F.sha2(F.concat(at["before"], own, at["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), ""), 256)


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, claimed: dict[str, Column] | None = None, keep: list[str] | None = None, fanout: int = 2, bits: int = PART_BITS) -> DataFrame:
    """keep, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs.

    Leaves are digests of the columns. claimed replaces columns by what is to be checked: folded_root is computed from the
    leaf of the claimed row and the siblings of the original one, verified says whether it is the root. Nulls are values
    of their own (- in a leaf, the first group, the first rows); empty and long texts are hashed whole; rows with the same
    order follow by their leaf, equal rows are leaves of their own; an empty table gives no rows. Other columns are ignored."""
    claimed, keep = claimed or {}, keep or [order]
    plain = docs.select(*dict.fromkeys([*columns, group, order, *keep]))
    checked = leaf_of([claimed.get(c, F.col(c)) for c in columns])
    tree = build(plain, F.col(group), [F.col(order)], leaf_of([F.col(c) for c in columns]), {**{f"k{i}": F.col(c) for i, c in enumerate(keep)}, "claimed": checked}, fanout, bits)
    tops = build(tree.roots, F.lit("all"), [F.col("tag")], F.col("root"), {"of": F.col("tag")}, fanout, bits)
    over = proven(tops).select(F.col("keep.of").alias("tag"), "path", F.col("top"))
    rows = proven(tree, checkpoint(over))
    again = folded(F.col("keep.claimed"), F.col("path"))
    out = rows.select(*[F.col(f"keep.k{i}").alias(c) for i, c in enumerate(keep)], "leaf", F.col("root").alias("subroot"), F.col("top").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
