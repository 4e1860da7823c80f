"""Operator 1: token-id files, coded by an adaptive context-mixing range coder.

A file set is a folder of Parquet files whose rows are segments: runs of whole documents in ascending doc_id order, with
the documents' ids and lengths, and the ids as independently reset, checksummed blocks (coder.py). Spark writes and
reads it, so that any store it reaches will do; a segment is bounded by SEGMENT ids or one document.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.llm import coder

#: Ids of a segment, about: it bounds a row and a task's memory.
SEGMENT = 1 << 22
#: Bytes of text tokenised at once (or one text), and distinct pieces of text and pre-tokens whose ids a task remembers.
AT_ONCE, REMEMBERED, WORDS = 1 << 23, 700_000, 1_000_000

SCHEMA = "part int, segment int, n long, bits int, doc_id array<long>, n_tokens array<long>, header binary, payload binary"

#: Fixed value: the characters that are white space to the tokenizer's pattern.
WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space between white space, or at the end after it, or at the start: such texts aren't cut at every space.
UNSAFE = rf"[{WHITE}] (?:[{WHITE}]|$)|^ "
BOUNDARY = re.compile(r"(?<=\S)(?= )")

#: Characters that every version of Unicode classes alike, and the tokenizer's pattern for texts of these alone.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u4e00-\u9fa5"
OTHERS = "!-/:-@\\[-`{-~\u00a1\u00a7\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201e\u2026"
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{OTHERS}]+|\s+(?!\S)|\s+")
#: The characters of bytes that a byte-level BPE's vocabulary shows as others; byte 0 stays.
HIDDEN = {chr(x): chr(256 + i) for i, x in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD]) if x}

_encoders: dict[str, Encoder] = {}


class Known:
    """The ids of distinct strings, in one array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.code: defaultdict[str | int, int] = defaultdict(count().__next__)
        self.ids, self.n = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def bound(self, most: int) -> None:
        """Forget all where there are more strings than that, or these are long."""
        if len(self.code) > most or len(self.ids) > 8 * most:
            self.clear()

    def codes(self, strings: list, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each string; encode gives the ids of unknown ones, and how many each one has."""
        before = len(self.code)
        code = np.fromiter(map(self.code.__getitem__, strings), np.int64, len(strings))
        if len(self.code) > before:
            try:
                ids, n = encode(list(islice(self.code, before, None)))
            except BaseException:
                self.clear()
                raise
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        return code

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these numbers' strings, one after another; where each one's end)."""
        size = self.n[code]
        ends = np.cumsum(size)
        at = np.repeat((np.cumsum(self.n) - self.n)[code] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], ends


class Encoder:
    """Ids of many texts: they are cut before spaces that follow other characters, as a byte-level BPE encodes the pieces as it does the whole, and each distinct piece is encoded once.

    Where the file's pre-tokenizer is the byte-level pattern and a piece has characters of undisputed classes alone, the
    piece is cut into its pre-tokens, and the library's model merges each distinct one once; the whole library encodes other pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # Spark runs a task a core: the tokenizer's own threads would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.known, self.words = Tokenizer.from_file(path), Known(), Known()
        self.merge = self.tokenizer.model.tokenize
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        laws = json.loads(self.tokenizer.to_str())
        before = laws["pre_tokenizer"] or {}
        bytewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        if not (bytewise and laws["normalizer"] is None and laws["model"]["type"] == "BPE" and laws["model"]["dropout"] is None):
            odd = r"(?s:.)"
        else:
            odd = "|".join([rf"[^ \t\n\r0-9{LETTERS}{OTHERS}]", *(re.escape(x["content"]) for x in laws["added_tokens"])])
        self.odd = re.compile(odd).search

    @staticmethod
    def of(path: str) -> Encoder:
        """One for each tokenizer file and worker process."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces by the whole library, number of each one's)."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pre-tokens by the library's model, number of each one's)."""
        shown = "\0".join(words).encode().decode("latin-1")
        for x in HIDDEN.keys() & set(shown):
            shown = shown.replace(x, HIDDEN[x])
        ids: list[int] = []
        n: list[int] = []
        for x in shown.split("\0"):
            tokens = self.merge(x)
            n.append(len(tokens))
            ids += [t.id for t in tokens]
        return np.array(ids, "<u4"), np.array(n, np.int64)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of different pieces, number of each one's)."""
        self.words.bound(WORDS)
        odd = {x for x in pieces if self.odd(x)} if self.odd("\n".join(pieces)) else set()
        self.words.codes(list(odd), self.whole)
        cut: list[str] = []
        upto = [0]
        for x in pieces:
            cut += (x,) if x in odd else PATTERN.findall(x)
            upto.append(len(cut))
        ids, ends = self.words.of(self.words.codes(cut, self.merged))
        return ids, np.diff(np.concatenate([[0], ends])[upto])

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end_id after each; number of ids of each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        rare = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        whole = [BOUNDARY.split(x) for x in texts.filter(unsafe).to_pylist()]
        cut = pc.split_pattern(pc.if_else(unsafe, "", texts), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        flat = cut.flatten()
        # Codes of pieces: those after a space, the first of each text, and the pieces of texts that aren't cut at every space.
        later, first = flat.dictionary_encode(), flat.take(pa.array(bounds[:-1])).dictionary_encode()
        table = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), later.dictionary, pa.scalar(" ", pa.large_string())).to_numpy(zero_copy_only=False).tolist()
        code = later.indices.to_numpy().astype(np.int64)
        code[bounds[:-1]] = first.indices.to_numpy() + len(table)
        table += first.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = {x: len(table) + i for i, x in enumerate(dict.fromkeys(x for w in whole for x in w))}
        table += own
        more = np.zeros(len(texts), np.int64)
        more[rare] = [len(w) for w in whole]
        where = np.concatenate([np.repeat(bounds[1:], more), bounds[1:]])
        code = np.insert(code, where, np.concatenate([np.array([own[x] for w in whole for x in w], np.int64), np.full(len(texts), len(table))]))
        self.known.bound(REMEMBERED)
        number = self.known.codes(table, self.pieces)
        end = self.known.codes([end_id], lambda ids: (np.array(ids, "<u4"), np.ones(1, np.int64)))
        out, ends = self.known.of(np.append(number, end)[code])
        ends = ends[np.cumsum(np.diff(bounds) + more + 1) - 1]
        return out, np.diff(ends, prepend=0)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with AT_ONCE bytes of its second column, about; or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE)))
        yield batch.slice(a, z - a)
        a = z


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending doc_id order to ``path``.

    A null or empty text is the end id alone. A null doc_id comes first; rows of equal doc_id are ordered by their
    text's hash, and equal rows are all written. Other columns are ignored. No rows make an empty file set.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer)
        part, number, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        coded: list[np.ndarray] = []
        n: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            header, payload = coder.encode(np.concatenate(coded), encode.bits)
            values = ([part], pa.int32()), ([number], pa.int32()), ([held], pa.int64()), ([encode.bits], pa.int32()), ([ids], pa.list_(pa.int64())), ([np.concatenate(n)], pa.list_(pa.int64())), ([header], pa.binary()), ([payload], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(*x) for x in values], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for few in slices(batch):
                found, size = encode(few.column(1), end_id)
                ends, documents, a = np.cumsum(size), few.column(0).to_pylist(), 0
                while a < len(size):
                    begin = int(ends[a] - size[a])
                    z = min(len(size), int(np.searchsorted(ends, begin + SEGMENT - held)) + 1)
                    ids += documents[a:z]
                    coded.append(found[begin : ends[z - 1]])
                    n.append(size[a:z])
                    held, a = held + len(coded[-1]), z
                    if held >= SEGMENT:
                        yield close()
                        number, held, ids, coded, n = number + 1, 0, [], [], []
        if ids:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(segments, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids: decoded from the files, each block checked."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["n"], row["header"], row["payload"], row["bits"])
                n = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(ends.tolist(), n.tolist(), strict=True)]
                for a in range(0, len(n), 4096):
                    z = min(len(n), a + 4096)
                    columns = [pa.array([row["part"]] * (z - a), pa.int32()), pa.array([row["segment"]] * (z - a), pa.int32()), pa.array(row["doc_id"][a:z], pa.int64()), pa.array((ends - n)[a:z]), pa.array(n[a:z]), pa.array(crc[a:z], pa.int64())]
                    if with_ids:
                        cut = np.concatenate([[0], ends[a:z] - (ends[a] - n[a])]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(ids[ends[a] - n[a] : ends[z - 1]].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    kinds = "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    files = spark.read.schema(SCHEMA).parquet(path)
    # A row a segment: the offsets of parts, then of the segments of a part.
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment")
    starts = files.select("part", "segment", "n").withColumn("before", F.sum("n").over(within) - F.col("n")).join(parts, "part")
    starts = starts.select("part", "segment", (F.col("before") + F.col("part_start")).alias("segment_start"))
    found = files.mapInArrow(documents, kinds).join(starts, ["part", "segment"])
    return found.select("doc_id", (F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
