"""Operator 12: repair of the structure of conversations by the cheapest edits, by dynamic programming over a trie.

A conversation's rows are, for the repair, a signature: a symbol a row of its role's initial and its first fault. A layer
of the programme holds, for each state of the wanted order of roles, the least cost and the ASCII-least edits of that
cost after so many symbols. Signatures are sorted; along the sorted ones a stack of layers is the path of a prefix trie, so
that a layer is computed once for all signatures of a task that share the prefix, and an answer is read off at its end.

Rows are sorted once over the whole table and cut into parts of bounded size (llm.indexed). A conversation's rows in a
part are a block; most conversations are one. A block that isn't a conversation's first is solved from each state; then
blocks are chained, and the edits chosen meet the rows again in one ordered pass. No conversation has to fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.indexed import indexed, tagged, untagged
from coppice.plans.materialize import table

#: Rows of a block are 2 ** BLOCK_BITS at most.
BLOCK_BITS = 12
#: White space, as in [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. The state after an inserted or changed role, and its role.
STATES, NEXT, ROLE = range(4), (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Edits that end a conversation in each state, and their cost.
LAST = ("", "II", "I", "")
KEEP, RENAME, DELETE, INSERT = 0, 2, 3, 2

Layer = dict[int, list[tuple[int, int, str, int] | None]]  # of each first state: by state (cost, rank, letters, state before)


def kept(kind: str, state: int) -> int | None:
    """The state after a row that is kept; None where its role can't follow."""
    return {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(kind, {}).get(state)


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letters, cost, state) of the ways over one row. Two insertions before a row are enough: two more change nothing."""
    out, kind, cut = [], symbol.lower(), int(symbol.isupper())
    for n in range(3):
        letters, cost = "I" * n, INSERT * n
        out.append((letters + "D", cost + DELETE, state))
        if kind != "d":
            out.append((letters + "R", cost + RENAME + cut, NEXT[state]))
            if (after := kept(kind, state)) is not None:
                out.append((letters + "K", cost + KEEP + cut, after))
        state = NEXT[state]
    return out


#: Symbols: d: has to go; s, u, a, x (another role), as capitals where the text is truncated.
MOVES = {symbol: [moves(symbol, state) for state in STATES] for symbol in "dsuaxSUAX"}


def ranked(found: list[tuple[int, int, str, int] | None]) -> list[tuple[int, int, str, int] | None]:
    """Entries with their order among the states in place of that of their predecessors. No two edit strings of one
    length in rows are prefixes of each other, as each ends with a row's edit: so orders decide once and for all."""
    order = sorted((e[1], e[2], z) for z, e in enumerate(found) if e)
    rank = {z: r for r, (_, _, z) in enumerate(order)}
    return [e and (e[0], rank[z], e[2], e[3]) for z, e in enumerate(found)]


def advanced(layer: Layer, symbol: str) -> Layer:
    out: Layer = {}
    for x, entries in layer.items():
        new: list[tuple[int, int, str, int] | None] = [None] * 4
        for before, entry in enumerate(entries):
            if entry:
                for letters, cost, z in MOVES[symbol][before]:
                    way = (entry[0] + cost, entry[1], letters, before)
                    if new[z] is None or way[:3] < new[z][:3]:
                        new[z] = way
        out[x] = ranked(new)
    return out


def start(first: bool) -> Layer:
    return {x: [(0, 0, "", x) if z == x else None for z in STATES] for x in ((0,) if first else STATES)}


def answers(layers: list[Layer]) -> tuple[list[int | None], list[int | None], list[str | None]]:
    """cost, rank, letters of each pair of a first and a last state (first * 4 + last); None where there is no way."""
    cost: list[int | None] = [None] * 16
    rank: list[int | None] = [None] * 16
    edits: list[str | None] = [None] * 16
    for x, entries in layers[-1].items():
        for z, entry in enumerate(entries):
            if entry:
                letters, at = [], z
                for layer in reversed(layers[1:]):
                    letters.append(layer[x][at][2])
                    at = layer[x][at][3]
                cost[x * 4 + z], rank[x * 4 + z], edits[x * 4 + z] = entry[0], entry[1], "".join(reversed(letters))
    return cost, rank, edits


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tag, part, key) sorted by key with cost, rank, edits. The stack of layers is the trie's path to the key."""
    path, layers, answer = "", [], None
    for batch in batches:
        found = []
        for key in batch.column(2).to_pylist():
            if key != path or answer is None:
                same = 0
                while same < min(len(path), len(key)) and path[same] == key[same]:
                    same += 1
                if not same:
                    layers = [start(key[0] == "^")]
                del layers[max(1, same) :]
                for symbol in key[len(layers) :]:
                    layers.append(advanced(layers[-1], symbol))
                path, answer = key, answers(layers)
            found.append(answer)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[i] for x in found], kinds[i]) for i in range(3)]], ["tag", "part", "cost", "rank", "edits"])


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tag, part, cost, rank) sorted by tag, part: tag, part, pick (of edits), last, cost: the last two of a
    conversation's last block only: the edits that end it and its whole cost."""

    def chosen(parts: list[int], backs: list[list[int]], state: list[tuple[int, int] | None]) -> list[tuple]:
        cost, _, z = min((s[0] + INSERT * len(LAST[z]), s[1], z) for z, s in enumerate(state) if s)
        out, end = [], (LAST[z], cost)
        for part, back in zip(reversed(parts), reversed(backs), strict=True):
            out.append((tag, part, back[z] * 4 + z, *end))
            z, end = back[z], (None, None)
        return out

    tag: str | None = None
    parts: list[int] = []
    backs: list[list[int]] = []
    state: list[tuple[int, int] | None] = []
    for batch in batches:
        out: list[tuple] = []
        for of, part, cost, rank in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if of != tag:
                if parts:
                    out += chosen(parts, backs, state)
                tag, parts, backs, state = of, [], [], [(0, 0), None, None, None]
            new: list[tuple | None] = [None] * 4
            for x, s in enumerate(state):
                for z in STATES:
                    if s and cost[x * 4 + z] is not None:
                        way = (s[0] + cost[x * 4 + z], s[1], rank[x * 4 + z], x)
                        if new[z] is None or way < new[z]:
                            new[z] = way
            order = {z: r for r, (_, _, z) in enumerate(sorted((w[1], w[2], z) for z, w in enumerate(new) if w))}
            state = [w and (w[0], order[z]) for z, w in enumerate(new)]
            parts.append(part)
            backs.append([w[3] if w else 0 for w in new])
        yield picks(out)
    if parts:
        yield picks(chosen(parts, backs, state))


def picks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"tag": pa.string(), "part": pa.int64(), "pick": pa.int32(), "last": pa.string(), "cost": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
BLOCK = [*COUNTS, "low", "high", "turns", "head", "tail"]
LEGAL = ("su", "ua", "au")


class Conversation:
    """A conversation of which blocks and rows pass in order: what is kept of it, and its repaired rows."""

    def __init__(self, tag: str) -> None:
        self.tag, self.state, self.cost, self.tail, self.high = tag, 0, 0, None, None
        self.counts, self.audit, self.last, self.low, self.turns = dict.fromkeys(COUNTS, 0), [], "", None, 0
        self.edits: Iterator[str] = iter(())

    def block(self, r: dict) -> None:
        for c in COUNTS:
            self.counts[c] += r[c]
        if self.tail is not None and self.tail + r["head"] not in LEGAL:
            self.counts["illegal"] += 1
        self.tail = r["tail"]
        if r["low"] is not None:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        self.audit.append(r["edits"])
        self.edits = iter(re.findall("I*[DKR]", r["edits"]))
        if r["last"] is not None:
            self.last, self.cost = r["last"], r["cost"]

    def inserted(self, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            yield "I", ROLE[self.state], ""
            self.state = NEXT[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that one row becomes."""
        edit = next(self.edits)
        yield from self.inserted(len(edit) - 1)
        if edit[-1] == "R":
            yield "R", ROLE[self.state], text
            self.state = NEXT[self.state]
        elif edit[-1] == "K":
            yield "K", role, text
            self.state = kept(role[:1], self.state)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


ROW_COLUMNS = ["tag", "pos", "of", "role", "text"]


def passed(batches: Iterator[pa.RecordBatch], row, end) -> Iterator[list]:
    """Of each batch what row(conversation, repaired row) and end(conversation) give, of sorted blocks and rows."""
    now: Conversation | None = None
    for batch in batches:
        out: list = []
        for r in batch.to_pylist():
            if now is None or r["tag"] != now.tag:
                if now is not None:
                    close(now, out, row, end)
                now = Conversation(r["tag"])
            if r["of"] == 0:
                now.block(r)
            else:
                out += [row(now, x) for x in now.row(r["role"], r["text"])]
        yield [x for x in out if x is not None]
    if now is not None:
        out = []
        close(now, out, row, end)
        yield [x for x in out if x is not None]


def close(now: Conversation, out: list, row, end) -> None:
    out += [row(now, x) for x in now.inserted(len(now.last))]
    out.append(end(now))


def marked(rows: DataFrame) -> DataFrame:
    """pos, part, tag, turn, kind (initial of the role), fault (blank, duplicate, truncated or none) of indexed rows."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = F.ltrim(stripped, F.lit(BLANKS)) == ""
    initial = F.substring("role", 1, 1)
    seen = rows.select("pos", "part", "tag", "turn", "mark", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("kind"), blank.alias("blank"), F.right(stripped, F.lit(1)).isin(".", "!", "?").alias("whole"))
    seen = table(seen, "conversation-marks")
    # the first row of a text in its conversation: first in each part, then by parts, so that a text held by very many rows has few
    own = seen.where("not blank").groupBy("tag", "mark", "part").agg(F.min("pos").alias("pos"))
    first = own.withColumn("_first", F.min("part").over(Window.partitionBy("tag", "mark"))).where("part = _first").select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("whole"), "truncated").otherwise("none")
    return seen.join(first, "pos", "left").select("pos", "part", "tag", "turn", "kind", fault.alias("fault"))


def blocks(rows: DataFrame) -> DataFrame:
    """A row for each conversation and part: its signature as key, counts, turns and roles at its ends."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind"))
    each = rows.groupBy("tag", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", symbol.alias("symbol")))).alias("r"), *[F.count_if(F.col("fault") == c).alias(c) for c in COUNTS[:3]], F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    kinds, n = F.col("r")["kind"], F.size("r")
    pairs = F.zip_with(F.slice(kinds, F.lit(1), n - 1), F.slice(kinds, F.lit(2), n - 1), lambda a, b: F.concat(a, b).isin(*LEGAL))
    first = F.row_number().over(Window.partitionBy("tag").orderBy("part")) == 1  # a row a block
    key = F.concat(F.when(first, "^").otherwise("~"), F.array_join(F.col("r")["symbol"], ""))
    return each.select("tag", "part", F.col("r")[0]["pos"].alias("pos"), key.alias("key"), *COUNTS[:3], F.size(F.filter(pairs, lambda x: ~x)).cast("long").alias("illegal"), "low", "high", "turns", kinds[0].alias("head"), F.element_at(kinds, -1).alias("tail"))


def planned(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, bits: int) -> DataFrame:
    """Blocks (of: 0), with the edits chosen, and rows (of: 1) of all conversations, sorted within partitions."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)]
    mark = F.md5(F.concat(F.octet_length(plain[0]).cast("string"), F.lit(":"), *plain))
    found = rows.select(tagged(F.col(conv_id)).alias("tag"), F.col(turn).cast("long").alias("turn"), mark.alias("mark"), plain[0].alias("role"), plain[1].alias("text"))
    lines = indexed(found, ["tag", "turn", "mark"], "conversation-rows", bits)
    cut = table(blocks(marked(lines)), "conversation-blocks")
    # dealt by the first symbols, as ranges are found from a sample of keys that the driver gets
    sorted_keys = cut.select("tag", "part", "key").repartitionByRange(F.substring("key", 1, 64), "tag", "part").sortWithinPartitions("key")
    solved = table(sorted_keys.mapInArrow(solve, "tag string, part long, cost array<long>, rank array<int>, edits array<string>"), "conversation-edits")
    chosen = solved.select("tag", "part", "cost", "rank").repartition("tag").sortWithinPartitions("tag", "part").mapInArrow(chain, "tag string, part long, pick int, last string, cost long")
    edits = chosen.join(solved.select("tag", "part", "edits"), ["tag", "part"]).select("tag", "part", "last", F.col("cost"), F.col("edits")[F.col("pick")].alias("edits"))
    both = cut.join(edits, ["tag", "part"]).select("tag", "pos", F.lit(0).alias("of"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *BLOCK, "last", "cost", "edits")
    own = lines.select("tag", "pos", F.lit(1).alias("of"), "role", "text")
    return both.unionByName(own, allowMissingColumns=True).repartition("tag").sortWithinPartitions("tag", "pos", "of")


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, place (from 0), edit (K kept, R another role, I inserted), role, text of all repaired conversations; see repair."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(now: Conversation, made: tuple) -> tuple:
            now.place = getattr(now, "place", -1) + 1
            return (now.tag, now.place, *made)

        for out in passed(batches, row, lambda now: None):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["tag", "place", "edit", "role", "text"])

    made = planned(rows, conv_id, turn, role, text, bits).mapInArrow(written, "tag string, place long, edit string, role string, text string")
    return made.select(untagged(F.col("tag"), rows.schema[conv_id].dataType.simpleString()).alias("conv_id"), "place", "edit", "role", "text")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: DataFrame | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation.

    Rows of a conversation go by turn (nulls first), of one turn by a hash of role and text; a null conv_id is a
    conversation, a null role or text is one space. Each row's first fault counts: blank, duplicate (role and text were
    seen before), truncated (the last character that isn't white space is none of .!?). gaps: turns that lack between the
    least and the largest. illegal: neighbours whose initials aren't su, ua or au. The cheapest edits give initials of
    (s?(ua)+)?: keep 0, another role 2, delete 3 (what a blank or a duplicate must be), insert an empty user or assistant row 2;
    a truncated row that stays adds 1. audit: their initials, the ASCII-least of the cheapest. repaired_sha256: of the lines
    role:text that result. every: conv_ids that are returned anyhow: without rows, zeros, no edits and the hash of nothing.
    Empty and very long texts, repeated rows and any number of rows in a conversation are handled; of an empty table nothing
    is returned. Other columns are ignored."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(now: Conversation, made: tuple) -> None:
            if not hasattr(now, "hash"):
                now.hash = hashlib.sha256()
            else:
                now.hash.update(b"\n")
            now.hash.update(f"{made[1]}:{made[2]}".encode())

        def end(now: Conversation) -> tuple:
            digest = getattr(now, "hash", hashlib.sha256()).hexdigest()
            return (now.tag, now.gaps(), *now.counts.values(), now.cost, "".join(now.audit) + now.last, digest)

        for out in passed(batches, row, end):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()))], names)

    names = ["tag", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    kinds = f"tag string, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired_sha256 string"
    out = planned(rows, conv_id, turn, role, text, bits).mapInArrow(told, kinds)
    if every is not None:
        out = every.select(tagged(F.col(conv_id)).alias("tag")).distinct().join(out, "tag", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(untagged(F.col("tag"), rows.schema[conv_id].dataType.simpleString()).alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with known faults, to test a repair by: by a hash of conv_id:turn one in 20 rows is dropped, emptied,
    stripped of .!?, repeated, or given to the user. Nulls are one space in the hash, in roles and in texts."""
    one: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn, role, text)}
    kind = F.crc32(F.concat(one[conv_id], F.lit(":"), one[turn]).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.translate(one[text], ".!?", "")).otherwise(one[text])
    by = F.when(kind == 4, "user").otherwise(one[role])
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(conv_id, turn, by.alias(role), said.alias(text), F.explode(times).alias("_copy")).drop("_copy")
