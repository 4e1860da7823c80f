"""Operator 13: near-duplicate documents by SetSketch registers, banded, compared by likelihood, then verified.

A set's register i is floor(1 - log_b x) + SHIFT, x the least of its tokens' exponential variates of hash function i, cut
off at 0 and LIMIT: exponentially spaced minima. The registers of a union are the larger ones of both sets' registers
(``merged``), and two sets' registers are equal, larger or smaller with probabilities that only their sizes and their Jaccard
similarity decide (M. Ertl, SetSketch: Filling the Gap between MinHash and HyperLogLog, 2021). Four registers are a band's
value; sets that share one in any of BANDS bands are candidates. Of a pair at 0.8 one in 10 ** 9 shares none.

As what is wanted is components, equal sets are one node, and each band value first compares its nodes with one hub. A pair
whose similarity the likelihood of its register differences rules out is dropped. Nodes of a value that then still lie in
different components are compared with each other by four bits of each register, in blocks of a value's nodes; of the pairs
that may be links only those come out that join components. All links lie within the components of the pairs that remain;
these are verified on the full sets, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.jaccard_join import identity, verified
from coppice.llm.rows import mark, place
from coppice.llm.words import mix, shingles
from coppice.operators.graph import components
from coppice.plans.materialize import checkpoint, table

#: Bands, and registers of a band: one 64-bit value of 16 bits each.
BANDS, WIDE = 40, 4
REGISTERS = BANDS * WIDE
#: Base of the spacing, rate of the variates, the largest register, and what keeps the smallest sets' registers above 0.
BASE, RATE, LIMIT, SHIFT = 1.001, 20.0, (1 << 16) - 1, 1024
#: A pair is dropped where its likelihood at the threshold is this many nats below the best one's: 6 standard deviations.
NATS = 18.0
#: A link at 0.8 differs in the low four bits of at most so many registers, but for one in 10 ** 9.
MOST_UNEQUAL = 66
#: Nodes of a block of a band value, and nodes of small values that share a group, about.
BLOCK, SHARED = 1 << 11, 1 << 13
#: Tokens that are hashed at once.
STEP = 1 << 16
_seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
ADD, TIMES = _seeds[:REGISTERS], _seeds[REGISTERS:] | np.uint64(1)


def registers(minima: np.ndarray) -> np.ndarray:
    """Registers of the least hashes (unsigned 64-bit, a column a hash function); none where a set is empty (the largest hash)."""
    x = -np.log1p(-np.minimum((minima.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)) + SHIFT, 0, LIMIT).astype(np.uint16)


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of each set (not empty) in each function."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sets):
        # whole sets of about STEP tokens; a larger one by itself, in steps
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + STEP, side="right")))
        if last == first + 1:
            own = sets[first]
            for i in range(REGISTERS):
                out[first, i] = min(((own[a : a + STEP] ^ ADD[i]) * TIMES[i]).min() for a in range(0, len(own), STEP))
        else:
            flat = np.concatenate(sets[first:last])
            starts = np.concatenate([[0], np.cumsum(sizes[first : last - 1])])
            work = np.empty_like(flat)
            for i in range(REGISTERS):
                np.bitwise_xor(flat, ADD[i], out=work)
                np.multiply(work, TIMES[i], out=work)
                out[first:last, i] = np.minimum.reduceat(work, starts)
        first = last
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def differ(share: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is larger: share is the part of the union that only this set has."""
    return -np.log1p(-share * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(jaccard: np.ndarray, n: tuple[np.ndarray, np.ndarray], larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Of the numbers of registers in which the first set's is larger or smaller, at a similarity; n: the sets' sizes."""
    u = n[0] / (n[0] + n[1])
    up, down = (np.maximum(differ(np.clip(x, 0, 1)), 1e-12) for x in (u - (1 - u) * jaccard, (1 - u) - u * jaccard))
    return larger * np.log(up) + smaller * np.log(down) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - up - down, 1e-12))


def estimated(n: tuple[np.ndarray, np.ndarray], larger: np.ndarray, smaller: np.ndarray, steps: int = 40) -> np.ndarray:
    """The similarity of largest likelihood, from 0 to that of one set within the other: by golden sections of a concave function."""
    ratio = (math.sqrt(5) - 1) / 2
    low, high = np.zeros(len(larger)), np.minimum(n[0], n[1]) / np.maximum(n[0], n[1])
    for _ in range(steps):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = log_likelihood(a, n, larger, smaller) > log_likelihood(b, n, larger, smaller)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def possible(a: np.ndarray, b: np.ndarray, n: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Whether pairs of registers (a row a set) leave a similarity of percent / 100 likely enough."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    best = estimated(n, larger, smaller)
    wanted = np.full(len(best), percent / 100)
    return (best >= wanted) | (log_likelihood(best, n, larger, smaller) - log_likelihood(wanted, n, larger, smaller) <= NATS)


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark, n, sid (128-bit identity of the set; null where empty), bands (REGISTERS packed), low (the registers' low four bits) of docs(doc_id, mark, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(x) for _, x in shingles(batch.column(2), k)]
            full = [s for s in sets if len(s)]
            found = registers(least_hashes(full)) if full else np.zeros((0, REGISTERS), np.uint16)
            nibbles = (found & 15).astype(np.uint8)
            packed = iter(nibbles[:, ::2] << 4 | nibbles[:, 1::2])
            low = [next(packed).tobytes() if len(s) else None for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)), pa.array(found.reshape(-1).view(np.int64)))
            sid = [identity(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.binary()), bands, pa.array(low, pa.binary())], ["doc_id", "mark", "n", "sid", "bands", "low"])

    return docs.select("doc_id", "mark", "text").mapInArrow(sign, "doc_id long, mark long, n long, sid binary, bands array<long>, low binary")


def spanning(hubs: np.ndarray, others: np.ndarray, label: np.ndarray, n: np.ndarray, low: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs of hubs and others that may be links, as many as join their components; label (of each node) is changed."""
    out: list[tuple[int, int]] = []
    for hub in hubs:
        rest = others[label[others] != label[hub]]
        if len(rest):
            m = n[rest]
            rest = rest[np.minimum(m, n[hub]) * 100 >= np.maximum(m, n[hub]) * percent]
            rest = rest[(low[rest] != low[hub]).sum(axis=1) <= MOST_UNEQUAL]
            for c, i in zip(*np.unique(label[rest], return_index=True), strict=True):
                out.append((hub, rest[i]))
                label[label == c] = label[hub]
    return out


def joining(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members(band, value, nid, n, c, low, held) that share a band value and may be links: no more than join
    the different components c of a value's nodes, in each pair of blocks of the value. Values of few nodes share groups."""
    total = members.where(F.col("held") <= BLOCK).count()
    key = F.xxhash64("band", "value")
    group = F.when(F.col("held") <= BLOCK, -1 - F.pmod(key, F.lit(1 + total // SHARED))).otherwise(key.bitwiseAND(F.lit((1 << 63) - 1)))
    blocks = F.ceil(F.col("held") / F.lit(BLOCK)).cast("int")
    dealt = members.select(group.alias("group"), "band", "value", "nid", "n", "c", "low", F.pmod(F.xxhash64("nid"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rows = rows.combine_chunks()
        band, value, nid, n, c, own = (rows[x].to_numpy() for x in ("band", "value", "nid", "n", "c", "own"))
        packed = np.frombuffer(b"".join(rows["low"].to_pylist()), np.uint8).reshape(-1, REGISTERS // 2)
        low = np.concatenate([packed >> 4, packed & 15], axis=1)
        order = np.lexsort((nid, value, band))
        cuts = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(value[order]) != 0)) + 1
        out = []
        for at in np.split(order, cuts):
            label = c[at]
            if (label != label[0]).any():
                sides = [np.flatnonzero(own[at] == x) for x in (i, j)]
                out += [(at[x], at[y]) for x, y in spanning(*sides, label, n[at], low[at], percent)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": nid[pairs[:, 0]], "b": nid[pairs[:, 1]]})

    return dealt.groupBy("group", "i", "j").applyInArrow(join, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose registers don't rule out a link."""
    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("n").alias(f"{x}_n"), F.col("bands").alias(f"{x}_bands"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_bands", "b_bands")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = tuple(batch.column(i).to_numpy().astype(float) for i in (2, 3))
                own, other = (batch.column(i).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(possible(own, other, n, percent)))

    return both.mapInArrow(weigh, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs, linked where 100 |A n B| >= percent |A u B|.

    A document's set is its distinct k-word shingles (A-Z count as a-z); fewer words make one shingle; no words, an empty or
    a null text make the empty set, which links with nothing: its component is its own doc_id. component_id is the smallest
    doc_id of the component; equal sets are linked. kept: doc_id is component_id (a null doc_id: where its component has no
    other). Rows without a doc_id are linked as others; repeated doc_ids are separate rows, all kept if they are the
    smallest. An empty table gives no rows. Other columns are ignored. percent is 80 at least: fewer bands find lower ones."""
    if percent < 80:
        raise ValueError("bands find pairs of similarity 0.8 and more")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    signed = table(signatures(docs, k), "sketch-signed")
    nodes = signed.where("n > 0").groupBy("sid").agg(F.min(place()).alias("row"), *[F.first(c).alias(c) for c in ("n", "bands", "low")])
    nodes = table(nodes.select("sid", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.doc_id", "row.mark").alias("key"), "n", "bands", "low", F.monotonically_increasing_id().alias("nid")), "sketch-nodes")

    at = nodes.select("nid", "n", F.posexplode("bands").alias("band", "value"))
    hubs = at.groupBy("band", "value").agg(F.count("*").alias("held"), F.min(F.struct("nid", "n")).alias("hub")).where("held > 1")
    hubs = table(hubs.select("band", "value", "held", F.col("hub.nid").alias("hub"), F.col("hub.n").alias("hub_n")), "sketch-hubs")
    stars = at.join(hubs, ["band", "value"]).where((F.col("nid") != F.col("hub")) & sizes_allow(F.col("n"), F.col("hub_n"), percent))
    pairs = stars.select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct()
    pairs = checkpoint(likely(pairs, nodes, percent))

    # of two nodes that share a value, one is its hub
    label = components(pairs, "a", "b")
    some = at.join(hubs.where("held > 2").select("band", "value"), ["band", "value"]).join(label.withColumnRenamed("node", "nid"), "nid", "left")
    some = table(some.select("band", "value", "nid", "n", F.coalesce("component", "nid").alias("c")), "sketch-open")
    several = some.groupBy("band", "value").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("held")).where("least < most").select("band", "value", "held")
    members = some.join(several, ["band", "value"]).join(nodes.select("nid", "low"), "nid")
    rest = checkpoint(joining(members, percent))

    label = checkpoint(components(pairs.union(rest), "a", "b"))
    found = verified(docs.select(F.xxhash64("doc_id", "mark").alias("key"), "text"), nodes, label, k, percent)
    label = components(found.where("root != nid"), "nid", "root")
    named = nodes.select("nid", "sid", "doc_id").join(label.withColumnRenamed("node", "nid"), "nid", "left").withColumn("c", F.coalesce("component", "nid"))
    named = named.select("sid", "c", "doc_id").join(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("sid", "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(named, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
