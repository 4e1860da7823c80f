import pytest
from pyspark.sql import functions as F

from coppice import queries as Q
from coppice.operators import sampling, train
from coppice.sources import models, names

NAMES = """# a table
1 width: continuous
2 colour : discrete red, green ,blue

3 kind: class a,b.
4 note: exclude
no colon here
"""


def test_names_round_trip():
    schema = names.parse(NAMES)
    assert [(a.name, a.kind, a.domain) for a in schema.attributes] == [("width", "continuous", ()), ("colour", "discrete", ("red", "green", "blue")), ("kind", "class", ("a", "b")), ("note", "exclude", ())]
    assert schema.target == 2 and names.parse(names.write(schema)) == schema
    assert names.parse(": continuous").attributes[0].name == "Atr1"
    with pytest.raises(ValueError):
        names.parse("x: discrete a,,b")
    assert names.ranges("1-3, 6") == [1, 2, 3, 6] and names.as_ranges([6, 1, 2, 3]) == "1-3,6"
    kinds = [a.kind for a in names.excluded(schema, [("exclude", "1-2"), ("include", "2")]).attributes]
    assert kinds == ["exclude", "discrete", "class", "exclude"]


def test_read_rows(spark, tmp_path):
    (tmp_path / "t.data").write_text("#labels width,colour,kind,note\n1.5, red ,a,x\n?,blue,b,y\n2,?,?,\nshort,red\n7,pink,a,z\n")
    schema = names.parse(NAMES)
    rows = names.read(spark, f"file://{tmp_path}/t.data", schema)
    assert rows.columns == ["row_id", "width", "colour", "label"]
    assert sorted(((r["width"], r["colour"], r["label"]) for r in rows.collect()), key=str) == sorted([(1.5, "red", 0), (None, "blue", 1), (2.0, None, None)], key=str)
    assert {r["problem"]: r["n"] for r in names.problems(spark, f"file://{tmp_path}/t.data", schema).collect()} == {"fields": 1, "width: number": 1, "colour: value": 1}


def test_models_and_regions(spark, tmp_path):
    nodes = models.node_table(spark, Q.TREE3)
    nodes.write.parquet(f"file://{tmp_path}/model")
    assert models.trees_of(spark.read.parquet(f"file://{tmp_path}/model")) == Q.TREE3
    assert models.invalid(nodes, 3).count() == 0 and models.invalid(nodes.where("id <> 1"), 3).count() > 0
    (tmp_path / "r.regions").write_text("dataset d\nnumber_of_timesteps 2\ntimestep 1\nnumber_of_regions 2\nregion_number 1\nregion_label 4\nmesh_number 1\nregion_size 2\nregion_members 5 9\nregion_number 2\nregion_label 4\nmesh_number 2\nregion_size 0\nregion_members\ntimestep 3\nnumber_of_regions 1\nregion_number 1\nregion_label 1\nmesh_number 1\nregion_size 1\nregion_members 7\n")
    want = [(1, 1, 4, 1, [5, 9]), (1, 2, 4, 2, []), (3, 1, 1, 1, [7])]
    rows = models.read_regions(spark, f"file://{tmp_path}/r.regions")
    assert [tuple(r) for r in rows.orderBy("timestep", "region").collect()] == want
    models.region_lines(rows).coalesce(1).select("value").write.text(f"file://{tmp_path}/again")
    assert [tuple(r) for r in models.read_regions(spark, f"file://{tmp_path}/again").orderBy("timestep", "region").collect()] == want


@pytest.mark.parametrize("n, shares, clumps, size", [([10000, 100], {1: 0.5}, 100, 200), ([120, 100, 1000, 5000, 110, 100, 4950, 10300, 7490, 6080], {0: 0.1, 1: 0.1, 4: 0.1, 5: 0.1}, 54, 1077)])
def test_clump_plan(spark, n, shares, clumps, size):
    rows = sampling.clump_plan(spark.createDataFrame(list(enumerate(n)), "label int, n long"), shares).collect()
    assert {r["clumps"] for r in rows} == {clumps} and sum(r["quota"] for r in rows) == size


def test_balanced_clumps_cover(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    seen = [{r["id"] for r in sampling.balanced_clump(rows, "id", "label", {0: 100}, t).where("label = 0").collect()} for t in range(9)]
    assert all(len(x) == 100 for x in seen) and len(set().union(*seen)) == 900


def test_boost_and_ivote(spark):
    rows = spark.range(300).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.when((F.col("id") < 90) | (F.col("id") >= 210), 1).otherwise(0).alias("label"))
    trees, betas = train.boost(rows, "id", ["a", "b"], 2, rounds=2, depth=1)
    assert len(trees) == len(betas) >= 1 and all(0 < b < 1 for b in betas)
    _, errors = train.ivote(rows, "id", ["a", "b"], 2, rounds=2, size=60, depth=2)
    assert len(errors) == 2 and all(0 <= e < 0.5 for e in errors)


def test_labels_strings_and_encoding(spark):
    schema = names.parse("a: continuous\nk: discrete x,y\nc: class u,v\n")
    rows = names.read_string(spark, "#labels a,k,c\n1,x,u\n?,?,v\n3,y,?\n", schema)
    assert sorted((r["a"] or 0, r["k"], r["label"]) for r in rows.collect()) == [(0, None, 1), (1.0, "x", 0), (3.0, "y", None)]
    assert names.encoded(rows, schema).where("k = 1").count() == 1 and names.domains(schema) == {"k": 2}
    with pytest.raises(ValueError):
        names.read_string(spark, "#labels a,c,k\n1,x,u\n", schema)
    with pytest.raises(ValueError):  # a later line too
        names.read_string(spark, "#labels a,k,c\n1,x,u\n#labels 1 a, 2 c, 3 k\n", schema)
    assert names.float_ranges("0.5-1.5,3") == [(0.5, 1.5), (3.0, 3.0)] and names.partitions(" a.data\n b.data ") == ["a.data", "b.data"]
    bad = spark.createDataFrame([("a,b", float("nan"))], "s string, x double")
    assert {(r["column"], r["n"]) for r in names.column_problems(bad).collect()} == {("s", 1), ("x", 1)}


def test_training_values_serve_testing(spark, tmp_path):
    (tmp_path / "a").write_text("1,x,u\n3,x,v\n5,y,u\n?,?,u\n")
    (tmp_path / "b").write_text("?,?,?\n")
    schema = names.parse("a: continuous\nk: discrete x,y\nc: class u,v\n")
    _, values = names.load_training(spark, f"file://{tmp_path}/a", schema)
    row = names.load_testing(spark, f"file://{tmp_path}/b", schema, values).first()
    assert (row["a"], row["k"], row["label"]) == (3.0, 0, None)
