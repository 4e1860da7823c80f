import glob
import os
import random

from pyspark.sql import functions as F

from coppice.llm import jaccard_join
from coppice.plans.materialize import shared_dir


def texts():
    """Copies, near copies and repeated rows among texts by themselves; ids may be missing."""
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(4000)}"
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200 + i, rows[i][1] + " more") for i in range(4, 9)]
    return rows + [(None, rows[20][1]), (None, rows[20][1]), (30, rows[30][1]), (31, rows[31][1] + " end"), (400, "!"), (401, ""), (402, None), (None, None)]


def test_prefixes_are_written_once(spark):
    """They are most of what the join writes; a node's is that of its least row."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/coppice"
    before = set(glob.glob(f"{folder}/jaccard-*"))
    jaccard_join.jaccard_components(spark.createDataFrame(texts(), "doc_id long, text string"), k=3, percent=90).count()
    found = {os.path.basename(p).rsplit("-", 1)[0]: spark.read.parquet(p).columns for p in set(glob.glob(f"{folder}/jaccard-*")) - before}
    assert [name for name, columns in found.items() if "prefix" in columns] == ["jaccard-signed"]


def test_rows_in_no_doubt_are_not_shuffled(spark, monkeypatch):
    """Only texts of components of several rows meet; with a filter that tells nothing all do, and the rows are the same."""
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    kept = jaccard_join.keep_one(docs)
    rows = sorted(kept.collect(), key=str)
    alone = [i for i in range(9, 60) if i not in (20, 30, 31)]
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {*range(60), 400, 401, 402} and len(rows) == 64
    told = max(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/coppice/jaccard-told-*"), key=os.path.getmtime)
    assert not {r["id"] for r in spark.read.parquet(told).where(~F.col("none")).collect()} & set(alone)
    linked = {r["doc_id"]: r["links"] for r in jaccard_join.jaccard_components(docs.where("doc_id is not null"), k=3, percent=90).collect()}
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 64)
    assert sorted(jaccard_join.keep_one(docs).collect(), key=str) == rows
    assert {r["doc_id"]: r["links"] for r in jaccard_join.jaccard_components(docs.where("doc_id is not null"), k=3, percent=90).collect()} == linked
