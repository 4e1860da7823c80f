"""Operator 7: benchmark items found in documents after template canonicalisation.

Numbers, units that follow numbers, and names (capitalised within a sentence) become typed placeholders; runs of names
one placeholder. Each item has windows of one length: WINDOW canonical tokens, or all of its own if it has fewer. Those
of which words are half at least are usable; they are hashed and joined. Along one alignment of item and document the
placeholders' fillers have to be consistent: one filler of the item meets one filler of the document (and for names and
units the other way round), so that a question with other names and numbers is found and a chance overlap of templates
is not. Pairs of fillers are accepted by the windows that hold them, most first; a window with a pair that contradicts
an accepted one isn't counted, the others are. An item without usable windows is found only as it stands: all of its
canonical tokens in order, with equal fillers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.rows import apart, mark, same
from coppice.llm.words import LOWER, chunks, hash_spans, mix, spans
from coppice.plans.materialize import table

WINDOW, LEAST = 8, 4
WORD, NUMBER, UNIT, NAME = range(4)
#: Unit words.
UNITS = "mm cm m km in ft yd mi g kg mg lb lbs oz t l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kph km kmh volt volts watt watts joule joules".split()
FILTER_BITS = 1 << 22

ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?:;\n\r\"(|"]] = True
PLACE = mix(np.array([3, 5, 7], np.uint64))
_units = None


def unit_hashes() -> np.ndarray:
    global _units
    if _units is None:
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        _units = np.unique(hash_spans(data, *spans(ALNUM[data], np.zeros(1, np.int64))))
    return _units


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind, canonical hash, first and end byte, document of each token of a chunk."""
    inside = ALNUM[data].copy()
    digit = DIGIT[data]
    point = (data == 46) | (data == 44)
    inside[1:-1] |= point[1:-1] & digit[:-2] & digit[2:]
    starts = at[:-1][at[:-1] < len(data)]
    first, end = spans(inside, starts)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    doc = np.searchsorted(at, first, side="right") - 1
    hashes = hash_spans(LOWER[data], first, end)
    digits = np.concatenate([[0], np.cumsum(digit)])
    kind = np.where(digits[end] > digits[first], NUMBER, WORD)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    after = np.concatenate([[False], (kind[:-1] == NUMBER) & ~new[1:]])
    maybe = np.flatnonzero(after & (kind == WORD))
    kind[maybe[np.isin(hashes[maybe], unit_hashes())]] = UNIT
    stops = np.concatenate([[0], np.cumsum(ENDS[data])])
    previous = np.concatenate([[0], end[:-1]])
    begins = new | (stops[first] > stops[previous])
    lead = data[first]
    second = data[np.minimum(first + 1, len(data) - 1)]
    upper = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    kind[upper & ~begins & (kind == WORD)] = NAME
    named = kind == NAME
    follows = np.concatenate([[False], named[1:] & named[:-1] & ~new[1:]])
    if follows.any():  # a run of names is one placeholder
        lasts = named & ~np.concatenate([follows[1:], [False]])
        end = end.copy()
        end[named & ~follows] = end[lasts]
        keep = ~follows
        kind, hashes, first, end, doc = kind[keep], hashes[keep], first[keep], end[keep], doc[keep]
    canonical = np.where(kind == WORD, hashes, PLACE[np.maximum(kind - 1, 0)])
    return kind, canonical, first, end, doc


def roll(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each n values in a row."""
    weights = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    m = len(values) - n + 1
    rolled = np.full(m, seed, np.uint64)
    for i in range(n):
        rolled += values[i : i + m] * weights[i]
    return mix(rolled)


def fillers(data: np.ndarray, kind: np.ndarray, first: np.ndarray, end: np.ndarray, i: int, n: int) -> list[str]:
    return [f"{kind[j]}:{data[first[j] : end[j]].tobytes().decode('utf-8', 'replace')}" for j in range(i, i + n) if kind[j] != WORD]


#: Seeds of windows that are found with equal fillers only: n + EXACT.
EXACT = 1 << 32


def item_windows(column: pa.Array) -> Iterator[tuple[int, int, int, int, int, bool, list[str]]]:
    """(row, window hash, position, tokens of the window, windows counted, exact, fillers) of each item's windows."""
    for row, _, at, data in chunks(column):
        kind, canonical, first, end, doc = tokens(data, at)
        raw = hash_spans(LOWER[data], first, end) if len(first) else canonical
        cut = np.searchsorted(doc, np.arange(len(at)))
        for d in range(len(at) - 1):
            a, b = int(cut[d]), int(cut[d + 1])
            if b - a < LEAST:
                continue
            n = min(WINDOW, b - a)
            words = np.concatenate([[0], np.cumsum(kind[a:b] == WORD)])
            usable = np.flatnonzero((words[n:] - words[:-n]) * 2 >= n)
            exact = not len(usable)
            rolled = roll(raw[a:b], n, n + EXACT) if exact else roll(canonical[a:b], n, n)
            places = range(b - a - n + 1) if exact else usable.tolist()
            for i in places:
                yield row + d, int(rolled[i].view(np.int64)), i, n, len(places), exact, fillers(data, kind, first, end, a + i, n)


def windows(column: pa.Array, kinds: list[tuple[int, bool]], wanted: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
    """(row, window hash, position, fillers) of the windows of the kinds (tokens, exact) that pass the filter."""
    for row, _, at, data in chunks(column):
        kind, canonical, first, end, doc = tokens(data, at)
        begin = np.searchsorted(doc, np.arange(len(at) - 1))
        raw = hash_spans(LOWER[data], first, end) if len(first) and any(exact for _, exact in kinds) else None
        for n, exact in kinds:
            m = len(doc) - n + 1
            if m <= 0:
                continue
            rolled = roll(raw, n, n + EXACT) if exact else roll(canonical, n, n)
            bit = (rolled & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            ok = (doc[:m] == doc[n - 1 :]) & (wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            for i in np.flatnonzero(ok).tolist():
                yield row + int(doc[i]), int(rolled[i].view(np.int64)), i - int(begin[doc[i]]), fillers(data, kind, first, end, i, n)


def found_in(rows: DataFrame, find: Callable[[pa.Array], Iterator[tuple]], schema: str) -> DataFrame:
    """id, mark and what find yields (the row first) for rows(id, mark, text)."""
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 512):
                found = list(find(batch.slice(a, 512).column(2)))
                if found:
                    row, *rest = zip(*found, strict=True)
                    at = pa.array([a + r for r in row])
                    yield pa.RecordBatch.from_arrays([ids.take(at), marks.take(at), *[pa.array(x, arrow[t]) for x, t in zip(rest, types, strict=True)]], ["id", "mark", *names])

    return rows.select(F.col("id").cast("long"), "mark", "text").mapInArrow(batches_of, f"id long, mark long, {schema}")


def accepted(pairs: Column) -> Column:
    """The pairs(n, ours, theirs) taken in order, most windows first, without those that contradict one taken before."""
    pair = "array<struct<n:bigint,ours:string,theirs:string>>"
    number = lambda x: x["ours"].startswith(f"{NUMBER}:")
    against = lambda x: lambda y: (y["ours"] == x["ours"]) | (~number(x) & ~number(y) & (y["theirs"] == x["theirs"]))
    ordered = F.array_sort(pairs, lambda x, y: F.when(x["n"] != y["n"], F.when(x["n"] > y["n"], -1).otherwise(1)).when(x["ours"] != y["ours"], F.when(x["ours"] < y["ours"], -1).otherwise(1)).when(x["theirs"] < y["theirs"], -1).when(x["theirs"] > y["theirs"], 1).otherwise(0))
    taken = F.aggregate(ordered, F.array().cast(pair), lambda s, x: F.when(F.exists(s, against(x)), s).otherwise(F.concat(s, F.array(x))))
    return F.transform(taken, lambda x: F.struct(x["ours"].alias("ours"), x["theirs"].alias("theirs")))


def marked_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """What contaminated returns, with mark: rows are told apart by doc_id and the hash of the text."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.lit(0).cast("long").alias("mark"), F.col(item_text).alias("text"))
    wanted = table(found_in(items, item_windows, "window long, at int, tokens int, windows int, exact boolean, fillers array<string>"), "benchmark-windows")
    kinds = sorted((r[0], r[1]) for r in wanted.select("tokens", "exact").distinct().collect())  # 2 WINDOW rows at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bit = F.col("window").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    packed = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("bits"))
    for byte, value in packed.collect():  # FILTER_BITS / 8 rows at most
        bits[byte] = value
    held = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    found = found_in(rows, lambda column: windows(column, kinds, held.value), "window long, at int, fillers array<string>").select(F.col("id").alias("doc_id"), "mark", "window", F.col("at").alias("doc_at"), F.col("fillers").alias("theirs"))
    hits = found.join(wanted.withColumnRenamed("id", "item_id").drop("mark"), "window").where((F.size("theirs") == F.size("fillers")) & (~F.col("exact") | (F.col("theirs") == F.col("fillers"))))
    hits = table(hits.select("doc_id", "mark", "item_id", "at", "windows", "exact", (F.col("doc_at") - F.col("at")).alias("shift"), F.arrays_zip(F.col("fillers").alias("ours"), F.col("theirs").alias("theirs")).alias("slots")), "benchmark-hits")
    along = ["doc_id", "mark", "item_id", "shift"]
    pairs = hits.select(*along, F.explode(F.array_distinct("slots")).alias("s")).groupBy(*along, F.col("s.ours").alias("ours"), F.col("s.theirs").alias("theirs")).agg(F.count("*").alias("n"))
    taken = pairs.groupBy(*along).agg(accepted(F.collect_list(F.struct("n", "ours", "theirs"))).alias("taken"))
    runs = hits.alias("r").join(taken.alias("h"), same([(F.col(f"r.{x}"), F.col(f"h.{x}")) for x in along]), "left").select("r.*", "taken")
    runs = runs.where((F.size("slots") == 0) | (F.size(F.array_except("slots", "taken")) == 0))
    runs = runs.groupBy(*along).agg(F.count_distinct("at").alias("matched"), F.max("windows").alias("windows"), F.max("exact").alias("exact"), F.min(F.forall("slots", lambda x: x["ours"] == x["theirs"])).alias("same_fillers"))
    runs = runs.where(F.col("matched") >= F.when(F.col("exact"), F.col("windows")).otherwise(F.least("windows", F.lit(LEAST))))
    best = Window.partitionBy("doc_id", "mark", "item_id").orderBy(F.desc("matched"), "shift")
    runs = runs.withColumn("place", F.row_number().over(best)).where("place = 1")
    return runs.select("doc_id", "mark", "item_id", F.col("matched").cast("long"), F.col("windows").cast("long"), F.round(F.col("matched") / F.col("windows"), 6).alias("coverage"), "same_fillers")

def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, matched, windows, coverage, same_fillers: documents that hold an item, or a re-parameterised one.

    matched: the item's windows found along one alignment, without those of contradicting fillers; windows: its usable
    ones. It takes LEAST of them (or all, of fewer). An item without usable windows takes all windows, with equal
    fillers. Items of fewer than LEAST tokens match nothing, null texts neither. Rows of one doc_id (or null) with different
    texts each have a result, equal rows have one together; other columns are ignored. same_fillers is of the counted windows. The join of windows has no hint:
    Spark broadcasts the items' side if it is small.
    """
    return marked_contaminated(docs, benchmark, doc_id, text, item_id, item_text).drop("mark")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that hold no benchmark item; all columns stay."""
    id_, mark_ = apart(docs, "id", "mark")
    gone = marked_contaminated(docs, benchmark).select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark")).distinct()
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), mark_: mark(F.col("text"))}).alias("d")
    left = keyed.join(gone.alias("g"), same([(F.col(f"d.{id_}"), F.col("g.g_id")), (F.col(f"d.{mark_}"), F.col("g.g_mark"))]), "left_anti")
    return left.drop(id_, mark_)
