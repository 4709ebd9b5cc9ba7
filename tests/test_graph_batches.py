"""Graph vectors and compact trees in Arrow batches, a bounded number of nodes at a time."""

from effnum.operators import graphs, trees, vectors


def _chain(doc, n):
    return [(doc, k, k - 1 if k else None) for k in range(n)]


def test_degree_profile_of_slices(spark, monkeypatch):
    """Documents on either side of a slice's end, lone roots, repeated links and a null key."""
    monkeypatch.setattr(graphs, "NODES", 4)
    rows = _chain(1, 5) + [(2, 0, None)] + [(3, 0, None), (3, 1, 0), (3, 1, 0)] + _chain(4, 3) + [(None, 0, None), (None, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, node int, parent int").coalesce(1)
    found = {r.doc_id: r.vec for r in graphs.local_degree_profile(df).collect()}

    def slot(x):
        import math

        return int(math.log1p(x) / graphs.LOG_RANGE * graphs.BINS)

    assert all(len(v) == 5 * graphs.BINS for v in found.values())
    assert [found[1][slot(d)] for d in (1, 2)] == [2, 3]  # ends and inner nodes of the chain
    assert found[1][graphs.BINS + slot(1)] == 2 and found[1][graphs.BINS + slot(2)] == 3  # least degree nearby
    assert [found[2][k * graphs.BINS] for k in range(5)] == [1] * 5
    assert found[3][slot(2)] == 2  # a link that is there twice counts twice
    assert found[4][slot(1)] == 2 and found[4][slot(2)] == 1
    assert found[None][slot(1)] == 2 and found[None][graphs.BINS] == 2


def test_parents_of_a_wide_and_a_deep_tree(spark):
    """Every node is looked at once: the search of all later nodes did not end on such trees."""
    n = 20_000
    wide = [("wide", k, 0 if k else None) for k in range(n)]
    rows = [(d, k, p, "x") for d, k, p in wide + _chain("deep", n)]
    df = spark.createDataFrame(rows, "doc_id string, node int, parent int, label string")
    edges = trees.tree_edges(trees.constituency_trees(df), [], "doc_id")
    found = {"wide": {}, "deep": {}}
    for r in edges.collect():
        found[r.doc_id][r.node] = r.parent
    assert found["wide"] == {k: n - 1 for k in range(n - 1)} | {n - 1: None}
    assert found["deep"] == {k: k + 1 for k in range(n - 1)} | {n - 1: None}


def test_means_of_many_groups_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FEW_GROUPS", 3)
    rows = [(g, i, [float(i % 2), 1.0]) for g in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "g int, id int, vec array<double>")
    many = vectors.similarity_mass(df, ["g"])
    few = vectors.similarity_mass(df.where("g < 2"), ["g"])
    got = sorted(map(tuple, many.where("g < 2").collect()))
    assert got == sorted(map(tuple, few.collect()))
    many.collect()
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
