from coppice.operators import graph, regions


def test_mesh_elements_are_joined_by_numbers(spark, monkeypatch):
    kinds, labelled = [], graph.labelled
    monkeypatch.setattr(graph, "labelled", lambda items, edges: kinds.append(dict(edges.dtypes)) or labelled(items, edges))
    values = spark.createDataFrame([(t, m, e, 1.0) for t in (2, 1) for m in (0, 1) for e in (9, 4, 7, 5)], "timestep int, mesh long, element long, value double")
    incidence = spark.createDataFrame([(t, m, e, n) for t in (1, 2) for m in (0, 1) for e, n in ((9, 1), (4, 1), (7, t), (5, 3))], "timestep int, mesh long, element long, node long")
    got = {tuple(r) for r in regions.mesh_segments(incidence, values, ">", 0.0).collect()}
    segment = lambda t, e: {1: {4: 0, 7: 0, 9: 0, 5: 1}, 2: {4: 0, 9: 0, 5: 1, 7: 2}}[t][e]
    assert got == {(t, m, e, segment(t, e)) for t in (1, 2) for m in (0, 1) for e in (9, 4, 7, 5)}
    assert kinds == [{"u": "bigint", "v": "bigint"}]
