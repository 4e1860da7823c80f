"""Operator 10: n-gram Jaccard join by prefix filters under several global token orders.

Two documents whose shingle sets have Jaccard similarity of at least t share, under *any* total order of the tokens,
one of the first n - ceil(t n) + 1 tokens of each (n: set size). The join uses three orders: rarest first (counts over
all documents in a fixed-size sketch, ties by hash), ascending hash and descending hash. The first one finds candidates
by an equi-join; with the positions of the shared token it also bounds the overlap. The other two are intersected with
it before a pair is verified exactly on the whole sets.

What is wanted is components, so not all pairs of a group are made: equal sets are one node; each shared token first
compares its nodes with one hub; only nodes of a token that then still lie in different components are paired, all of
them, with a join on (token, set size) in which both position bounds are part of the condition. No cap drops any pair.
Pairs are dropped here by parity sketches, which bound two sets' difference from below. So all links lie within the
components of the pairs that remain; their texts are fetched, and in blocks of their sets the other two orders' prefixes are
intersected and what then remains is verified. A block gives each set its number of links and a spanning link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.rows import apart, mark, place
from coppice.llm.words import shingles
from coppice.operators.graph import components
from coppice.plans.materialize import table

#: Counters of the sketch: 4 MB a task and 2 MB on the driver, whatever the input.
SKETCH = 1 << 21
SLICES = 64
#: 64-bit words of a set's parity sketch.
PARITY = 8
SKETCHED = [f"s{i}" for i in range(PARITY)]
#: Bits of the filter that says which documents' sets are needed, so that few texts are read whole: 1 / 64 rows at most.
FILTER_BITS = 1 << 24
#: Tokens, and sets, of a block that is verified at once, about (two blocks are a task's memory), and sets of small components that share one.
BLOCK, BLOCK_SETS, SHARED = 1 << 19, 1 << 12, 64


def sketch_counts(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Documents' shingles counted by hash bucket over all rows, on a logarithmic scale of a byte a bucket.

    Each task counts into one fixed vector and emits its slices; a second job adds the slices as they stream by. The
    driver gets SKETCH bytes.
    """
    wide = SKETCH // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            found = [x for _, x in shingles(batch.column(0), k)]
            if found:
                total += np.bincount((np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if total.any():
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(SLICES, wide)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_buffer(), np.uint16).astype(np.uint32)
        for i, x in sums.items():
            scale = np.minimum(255, np.log2(x.astype(float) + 1) * 6).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([scale.tobytes()], pa.binary())], ["slice", "counts"])

    parts = docs.select(text).mapInArrow(count, "slice int, counts binary").repartition(SLICES // 4, "slice").mapInArrow(add, "slice int, counts binary")
    scale = np.zeros((SLICES, wide), np.uint8)
    for row in parts.collect():  # SLICES rows
        scale[row[0]] = np.frombuffer(row[1], np.uint8)
    return scale.reshape(-1)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Of each of 64 * PARITY classes of tokens, whether it has an odd number of them. Two sets differ in at least as many tokens as their sketches in bits."""
    odd = np.bincount((tokens >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def identity(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def signatures(docs: DataFrame, k: int, percent: int, scale: np.ndarray) -> DataFrame:
    """doc_id, mark, n, sid (128-bit identity of the set; null where empty), the parity sketch and the prefix tokens, rarest first, of docs(doc_id, mark, text)."""
    known = docs.sparkSession.sparkContext.broadcast(scale)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = known.value
        for batch in batches:
            n, sid, prefix, odd = [], [], [], []
            for _, rolled in shingles(batch.column(2), k):
                tokens = np.unique(rolled)
                n.append(len(tokens))
                sid.append(identity(tokens) if len(tokens) else None)
                most = len(tokens) - -(-len(tokens) * percent // 100) + 1 if len(tokens) else 0
                rank = order[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
                prefix.append(tokens[np.argsort(rank, kind="stable")[:most]].view(np.int64))
                odd.append(parity(tokens))
            sketch = np.array(odd, np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), *[pa.array(sketch[:, i]) for i in range(PARITY)], lists(prefix)], ["doc_id", "mark", "n", "sid", *SKETCHED, "prefix"])

    return docs.select("doc_id", "mark", "text").mapInArrow(sign, f"doc_id long, mark long, n long, sid binary, {', '.join(f'{c} long' for c in SKETCHED)}, prefix array<long>")


def at_least(overlap: Column, size: Column, percent: int) -> Column:
    """overlap / (size - overlap) >= percent / 100, in integers; size: of both sets together."""
    return overlap * (100 + percent) >= size * percent


def possible(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and the shared token's positions (from 0) leave room for enough overlap."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return at_least(left, F.col(f"{a}.n") + F.col(f"{b}.n"), percent) & (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent)


def close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity sketches leave room for similar sets."""
    sketch = lambda x: nodes.select(F.col("nid").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(c).alias(f"{x}_{c}") for c in SKETCHED])
    both = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCHED), F.lit(0))
    return both.where(differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)).select("a", "b")


def flagged(rows: DataFrame, key: str, wanted: DataFrame, flag: str) -> DataFrame:
    """rows with flag: true where key is among those of wanted(key), and for a few other keys: by a bitmap of hashes, broadcast
    as FILTER_BITS / 64 rows at most, so that rows without the flag are neither sent to Python nor shuffled."""
    bit_, word_, bits_ = apart(rows, "bit", "word", "bits")
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias(bit_)).groupBy(F.shiftright(bit_, 6).alias(word_)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit_} & 63 as int))")).alias(bits_))
    placed = rows.withColumn(bit_, bit).withColumn(word_, F.shiftright(bit_, 6)).join(F.broadcast(words), word_, "left")
    return placed.withColumn(flag, F.coalesce(F.expr(f"shiftright({bits_}, cast({bit_} & 63 as int)) & 1") == 1, F.lit(False))).drop(bit_, word_, bits_)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(nid, sid, key, ...) with the text of docs(key, text): less to shuffle than the set. Repeated rows bring it once;
    a key that two rows share can bring another row's text, whose set is not the node's."""
    named = table(wanted, "jaccard-wanted")
    return flagged(docs, "key", named.select("key"), "wanted").where("wanted").drop("wanted").join(named, "key").distinct()  # dealt as the join is


def overlaps(row: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """How many tokens each row of left shares with each row of right, of (row, token) cells: products of 0/1 matrices."""
    _, token, times = np.unique(token, return_inverse=True, return_counts=True)
    keep = times[token] > 1  # tokens of one set only are in no intersection
    shared, token = np.unique(token[keep], return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[keep][order], token[order]
    out = np.zeros((len(left), len(right)), np.int32)
    mine, theirs = np.full(rows, -1), np.full(rows, -1)
    mine[left], theirs[right] = np.arange(len(left)), np.arange(len(right))
    wide = max(1, (1 << 23) // max(1, len(left) + len(right)))  # columns at once: 32 MB
    for a in range(0, len(shared), wide):
        lo, hi = np.searchsorted(token, [a, a + wide])
        r, t = row[lo:hi], token[lo:hi] - a
        n = min(wide, len(shared) - a)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        x[mine[r[mine[r] >= 0]], t[mine[r] >= 0]] = 1
        y[theirs[r[theirs[r] >= 0]], t[theirs[r] >= 0]] = 1
        out += (x @ y.T).astype(np.int32)
    return out


def verified(docs: DataFrame, nodes: DataFrame, label: DataFrame, k: int, percent: int) -> DataFrame:
    """nid, links, root: of each set and pair of blocks that it is in, how many others it is linked with there, and the least
    set that it is joined to by these links.

    label: node, component. A component's sets are dealt to blocks of about BLOCK tokens and BLOCK_SETS sets, and each pair
    of blocks is one group: no row is made for a pair. Small components share groups of about SHARED sets. A text is fetched
    once, and sent as often as its component has blocks, once for most; its set is made in the group. docs: key, text; nodes: nid, sid, key, n.
    """
    found = nodes.select("nid", "sid", "key", "n").join(label.withColumnRenamed("node", "nid"), "nid")
    sizes = found.groupBy("component").agg(F.count("*").alias("m"), F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(BLOCK_SETS))).cast("int").alias("blocks"))
    sizes = table(sizes, "jaccard-sizes")
    small = sizes.where(F.col("m") <= SHARED).agg(F.sum("m")).first()[0] or 0
    group = F.when(F.col("m") <= SHARED, -1 - F.pmod(F.xxhash64("component"), F.lit(1 + small // SHARED))).otherwise(F.col("component"))
    blocks = F.when(F.col("m") <= SHARED, 1).otherwise(F.col("blocks"))
    found = found.join(sizes, "component").select("nid", "sid", "key", group.alias("group"), blocks.alias("blocks"), F.pmod(F.xxhash64("nid"), blocks).cast("int").alias("own"))
    dealt = texts_of(docs, found).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "nid", "sid", "text")

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        rows = rows.combine_chunks()
        sets = [np.unique(x) for _, x in shingles(rows["text"], k)]
        own, nid, sid = rows["own"].to_numpy(), rows["nid"].to_numpy(), rows["sid"].to_pylist()
        good = np.array([i for i, x in enumerate(sets) if identity(x) == sid[i]], np.int64)
        good = good[np.unique(nid[good], return_index=True)[1]]
        own, nid, sets = own[good], nid[good], [sets[i] for i in good]
        n, flat = np.array([len(x) for x in sets], np.int64), np.concatenate([np.zeros(0, np.uint64), *sets])
        row = np.repeat(np.arange(len(n)), n)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # tokens are sorted as unsigned numbers: a set's first ones are its prefix in ascending, its last ones in descending order
        at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        prefix = (n + (-n * percent) // 100 + 1)[row]
        may = np.ones((len(left), len(right)), bool)
        for head in (at < prefix, at >= n[row] - prefix):
            may &= overlaps(row[head], flat[head], left, right, len(n)) > 0
        linked = np.zeros_like(may)
        if may.any():
            overlap = overlaps(row, flat, left, right, len(n))
            linked = may & (overlap * (100 + percent) >= (n[left][:, None] + n[right][None, :]) * percent)
        if i == j:
            np.fill_diagonal(linked, False)
        links, root = np.zeros(len(n), np.int64), nid.copy()
        links[left] += linked.sum(axis=1)
        if i != j:
            links[right] += linked.sum(axis=0)
        top = np.iinfo(np.int64).max
        while linked.any():
            before = root.copy()
            root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], top).min(axis=1))
            root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], top).min(axis=0))
            if (root == before).all():
                break
        return pa.table({"nid": nid, "links": links, "root": root})

    return table(dealt.groupBy("group", "i", "j").applyInArrow(verify, "nid long, links long, root long"), "jaccard-links")


def candidates(split: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of split(token, nid, n, pos, c) of different c that share a token within both position bounds."""
    # Of a pair the smaller set's token must be at a position that leaves room for the larger (up to limit); sizes are
    # matched by geometric classes, of which a span of 100 / percent touches two or three.
    limit = F.floor((F.lit(100 + percent) * (F.col("n") - F.col("pos")) - percent * F.col("n")) / F.lit(percent))
    size_class = lambda n: F.floor(F.log(n) / F.lit(math.log(100 / percent))).cast("int")
    smaller = split.withColumn("limit", F.least(limit, F.floor(F.col("n") * 100 / F.lit(percent)))).where("limit >= n")
    smaller = smaller.withColumn("class", F.explode(F.sequence(size_class(F.col("n")), size_class(F.col("limit") + 0.5))))
    larger = split.withColumn("class", size_class(F.col("n")))
    rest = smaller.alias("x").join(larger.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.n") <= F.col("y.n")) & possible("x", "y", percent))
    return rest.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()


def marked_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, links, c (a number of the component) for each row of docs(doc_id, mark, text)."""
    scale = sketch_counts(docs, "text", k)
    signed = table(signatures(docs, k, percent, scale).withColumn("rid", F.monotonically_increasing_id()), "jaccard-signed")
    full = signed.where("n > 0")
    nodes = full.groupBy("sid").agg(F.min("rid").alias("nid"), F.count("*").alias("rows"), F.min(place()).alias("row"), *[F.first(c).alias(c) for c in ("n", *SKETCHED)])
    nodes = table(nodes.select("nid", "sid", "rows", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.doc_id", "row.mark").alias("key"), "n", *SKETCHED), "jaccard-nodes")

    # a node's prefix is that of its least row; rows whose set no other row has are not shuffled to find that out
    several = nodes.where("rows > 1").select("sid", F.col("nid").alias("least"))
    rows = flagged(full.select("rid", "n", "sid", "prefix"), "sid", several.select("sid"), "several")
    least = rows.where("several").join(several, "sid", "left").where("least is null or least = rid")
    rows = rows.where("not several").select("rid", "n", "prefix").union(least.select("rid", "n", "prefix"))
    at = rows.select(F.col("rid").alias("nid"), "n", F.posexplode("prefix").alias("pos", "token"))
    # one shuffle tells how many nodes hold a token and which one is its hub
    holders = Window.partitionBy("token").orderBy("pos", "n", "nid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.withColumns({"held": F.count("*").over(holders), "h": F.struct(*[F.first(c).over(holders).alias(c) for c in ("pos", "n", "nid")])})
    at = table(at.where("held > 1"), "jaccard-prefixes")

    pairs = at.select(F.struct("pos", "n", "nid").alias("x"), "h").where((F.col("x.nid") != F.col("h.nid")) & possible("x", "h", percent))
    pairs = pairs.select(F.least("x.nid", "h.nid").alias("a"), F.greatest("x.nid", "h.nid").alias("b")).distinct()
    pairs = table(close(pairs, nodes, percent), "jaccard-pairs")

    label = components(pairs, "a", "b")
    # of two nodes that hold a token, one is its hub
    split = at.where("held > 2").join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("c", F.coalesce("component", "nid"))
    split = split.select("token", "nid", "n", "pos", "c")
    open_tokens = split.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    rest = table(close(candidates(table(split.join(open_tokens, "token"), "jaccard-open"), percent), nodes, percent), "jaccard-rest")
    # the components so far are stars: only what rest adds has to be closed
    stars = label.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = table(components(stars.union(rest), "a", "b"), "jaccard-label")
    found = verified(docs.select(F.xxhash64("doc_id", "mark").alias("key"), "text"), nodes, label, k, percent)
    label = components(found.where("root != nid"), "nid", "root")
    degree = found.groupBy("nid").agg(F.sum("links").alias("links"))

    named = nodes.select("nid", "sid", "doc_id").join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("c", F.coalesce("component", "nid"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "c").join(degree, "nid", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    out = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"), "sid").join(named.select("sid", "c", "component_id", "links"), "sid", "left")
    alone = F.col("sid").isNull()
    return out.select("doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), "c")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, links for each row of docs, linked where 100 |A n B| >= percent |A u B|.

    A document's set is its distinct k-word shingles; fewer words make one shingle; no words (or a null text) make the
    empty set, which links with nothing: its component is its own doc_id. component_id is the smallest doc_id of the
    component; equal sets are linked. Rows with a null doc_id are linked as others; a component without any id is null.
    Repeated doc_ids are separate rows. An empty table gives no rows. Other columns of docs are ignored. links: how many
    different sets are linked with the row's set.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return marked_components(docs, k, percent).drop("mark", "c")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs of which no earlier row (by doc_id) is in the same component; all columns stay.

    The row that stays is the one with the component's smallest doc_id (of rows that repeat that id, or have none where no
    row of the component has one, the one whose text has the least hash; of equal ones, one). Rows without words stay. An
    empty table stays empty.
    """
    id_, mark_, none_, first, n, key, maybe = apart(docs, "id", "mark", "none", "first", "n", "key", "maybe")
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), mark_: mark(F.col("text"))})
    found = marked_components(keyed.select(F.col(id_).alias("doc_id"), F.col(mark_).alias("mark"), "text"), k, percent)
    found = table(found.where("n_shingles > 0").select("c", "doc_id", "mark"), "jaccard-found")
    # rows of components of several rows (repeated ones are) are in doubt, and only their texts are shuffled
    least = found.groupBy("c").agg(F.min(place()).alias("f"), F.count("*").alias("rows")).where("rows > 1")
    # keys without nulls, so that the join's dealing serves the numbering of equal rows too
    zero = F.lit(0).cast("long")
    told = found.join(least, "c").select(F.col("doc_id").isNull().alias(none_), F.coalesce("doc_id", zero).alias(id_), F.coalesce("mark", zero).alias(mark_), place().eqNullSafe(F.col("f")).alias(first))
    told = table(told.groupBy(none_, id_, mark_).agg(F.max(first).alias(first)), "jaccard-told")
    hashed = F.xxhash64(none_, id_, mark_).alias(key)
    known = keyed.withColumns({none_: F.col(id_).isNull(), id_: F.coalesce(id_, zero), mark_: F.coalesce(mark_, zero)})
    known = flagged(known.select("*", hashed), key, told.select(hashed), maybe)
    both = known.where(F.col(maybe)).join(told, [none_, id_, mark_], "left").withColumn(n, F.row_number().over(Window.partitionBy(none_, id_, mark_).orderBy(F.lit(0))))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    stay = both.where(wordless | F.col(first).isNull() | F.col(first) & (F.col(n) == 1))
    return known.where(~F.col(maybe)).select(*docs.columns).union(stay.select(*docs.columns))
