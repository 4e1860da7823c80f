"""Votes of an ensemble under growth, kept as files that are only ever added to, with running counts for each row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.operators.scoring import winner
from coppice.plans.materialize import checkpoint, scratch, table

#: Votes times classes of a block that are added up by one generated expression.
FEW_TERMS = 64


class VoteStore:
    """Blocks of votes(row, label, tree, pred), later trees in later blocks, and the counts of each row's votes after the last.

    A block is written once; of the earlier ones only the counts are read again. The votes stay when training ends: they are
    the out-of-bag or test votes of the ensemble, by row and tree."""

    def __init__(self, spark: SparkSession, row: str, classes: int, name: str = "votes") -> None:
        self.spark, self.row, self.classes, self.path, self.blocks = spark, row, classes, scratch(spark, name), 0
        self.parts: list[DataFrame] = []
        self.last: DataFrame | None = None

    def append(self, votes: DataFrame) -> DataFrame:
        """Adds votes of new trees; tree, rows, error, accuracy of them: of the rows that vote on a tree how many, the error of
        their vote with all trees so far (ties go to the lowest class), and the accuracy of the tree by itself."""
        row, classes = self.row, range(self.classes)
        votes.select(row, "label", "tree", "pred").write.parquet(f"{self.path}/votes/block={self.blocks}")
        new = self.spark.read.parquet(f"{self.path}/votes/block={self.blocks}")
        before = self.counts()
        upto = Window.partitionBy(row).orderBy("tree").rowsBetween(Window.unboundedPreceding, 0)  # a row's votes in a block
        counted = new.select("*", *[F.sum(F.when(F.col("pred") == k, 1).otherwise(0)).over(upto).alias(f"n{k}") for k in classes])
        if before is None:
            sums = [F.col(f"n{k}") for k in classes]
        else:
            counted = counted.join(before.drop("label"), row, "left")
            sums = [F.col(f"n{k}") + F.coalesce(F.col(f"v{k}"), F.lit(0)) for k in classes]
        curve = counted.groupBy("tree").agg(F.count("*").alias("rows"), (F.count_if(winner(sums) != F.col("label")) / F.count("*")).alias("error"), (F.count_if(F.col("pred") == F.col("label")) / F.count("*")).alias("accuracy"))
        curve = checkpoint(curve)  # a row a tree
        each = new.select(row, "label", *[F.when(F.col("pred") == k, 1).otherwise(0).cast("long").alias(f"v{k}") for k in classes])
        both = each if before is None else each.unionByName(before)
        both.groupBy(row, "label").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in classes]).write.parquet(f"{self.path}/counts/{self.blocks}")
        self.last = self.spark.read.parquet(f"{self.path}/counts/{self.blocks}")
        self.parts.append(new)
        self.blocks += 1
        return curve

    def append_beside(self, rows: DataFrame, said: str, first: int, trees: int) -> tuple[DataFrame, DataFrame]:
        """The same of rows(row, label, said, others) that have the votes of a block's trees (from first on; null: none) beside
        them in an array and, after the first block, the counts v0.. so far: nothing is joined or shuffled. Also the rows with their counts
        after the block, without said, which the next call gets."""
        row, names = self.row, [f"v{k}" for k in range(self.classes)]
        rows = table(rows if self.blocks else rows.withColumns({c: F.lit(0).cast("long") for c in names}), "votes-beside")
        places = [rows.columns.index(c) for c in names]
        others = [c for c in rows.columns if c != said]

        def votes_of(batch: pa.RecordBatch) -> np.ndarray:
            listed = batch.column(batch.schema.names.index(said))
            return listed.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                votes, label = votes_of(batch), batch.column(0).to_numpy()
                counts, out = np.stack([batch.column(2 + k).to_numpy() for k in range(len(names))], axis=1), []
                for t, pred in enumerate(votes.T):
                    at = np.flatnonzero(pred >= 0)
                    counts[at, pred[at]] += 1
                    out.append((first + t, len(at), int((counts[at].argmax(axis=1) != label[at]).sum()), int((pred[at] == label[at]).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["tree", "rows", "wrong", "right"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(batch.columns)
                if batch.num_rows:
                    votes = votes_of(batch)
                    for k, i in enumerate(places):
                        columns[i] = pa.array(columns[i].to_numpy() + (votes == k).sum(axis=1))
                yield pa.RecordBatch.from_arrays([columns[batch.schema.names.index(c)] for c in others], others)

        sums = rows.select("label", said, *names).mapInArrow(told, "tree long, rows long, wrong long, right long").groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("rows", "wrong", "right")])
        curve = checkpoint(sums.where("rows > 0").select(F.col("tree").cast("int"), "rows", (F.col("wrong") / F.col("rows")).alias("error"), (F.col("right") / F.col("rows")).alias("accuracy")))  # a row a tree
        if trees * self.classes <= FEW_TERMS:
            cast = lambda k: sum((F.when(F.get(said, F.lit(t)) == k, 1).otherwise(0) for t in range(trees)), F.lit(0).cast("long"))
            after = rows.withColumns({c: F.col(c) + cast(k) for k, c in enumerate(names)}).select(*others)
        else:
            after = rows.mapInArrow(added, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != said))
        self.parts.append(rows.select(row, "label", F.posexplode(said).alias("_at", "pred")).where("pred is not null").select(row, "label", (F.col("_at") + first).alias("tree"), "pred"))
        self.last = after.where(sum([F.col(c) for c in names], F.lit(0)) > 0).select(row, "label", *names)
        self.blocks += 1
        return curve, after

    def counts(self) -> DataFrame | None:
        """row, label, v0..: the votes of each row that has any; None before the first block."""
        return self.last

    def votes(self) -> DataFrame | None:
        """row, label, tree, pred of all blocks."""
        return reduce(DataFrame.unionByName, self.parts) if self.parts else None
