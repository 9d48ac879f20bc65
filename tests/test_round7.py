"""Communities by numbers, in few stages, and which of a hierarchy fall apart."""

from loomgraph.operators import graph as G


def _rings(spark, n=6, size=5):
    """Rings of `size` vertices, each linked with the next ring once; names aren't in the order of the rings."""
    e = [(f"v{(7 * (size * r + i)) % (n * size):02d}", f"v{(7 * (size * r + (i + 1) % size)) % (n * size):02d}", 3.0) for r in range(n) for i in range(size)]
    e += [(f"v{7 * size * r % (n * size):02d}", f"v{7 * size * (r + 1) % (n * size):02d}", 1.0) for r in range(n - 1)]
    v = spark.createDataFrame([(f"v{i:02d}",) for i in range(n * size)] + [("zz",)], "id string")
    return G.cut(G.simple(spark.createDataFrame(e, "src string, dst string, weight double"))), v


def test_communities_in_one_task_and_in_many(spark, monkeypatch):
    """a partition doesn't depend on how the edges are dealt, nor on names being strings or their numbers."""
    e, v = _rings(spark)
    one = sorted(map(tuple, G.moved(e, v).collect()))
    numbers, w = G.numbered(e, v)
    name = {r.id: r.name for r in w.collect()}
    assert sorted(name.values()) == [name[i] for i in sorted(name)]
    assert sorted((name[r.id], name[r.community]) for r in G.moved(numbers, w.select("id", "turns")).collect()) == one
    monkeypatch.setattr(G, "EDGES_A_TASK", 20)
    assert sorted(map(tuple, G.moved(e, v).collect())) == one
    assert dict(one)["zz"] == "zz" and len({c for _, c in one}) < len(one)


def test_communities_fall_apart(spark):
    """all levels are tested, each on what hangs together of the one below."""
    e = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("f", "g", 1.0)], "src string, dst string, weight double")
    rows = [(0, i, c, p) for i, c, p in [("a", "a", "a"), ("b", "a", "a"), ("c", "c", "c"), ("d", "d", "c"), ("e", "c", "c"), ("f", "f", "c"), ("g", "f", "c")]]
    rows += [(1, i, p, None) for _, i, _, p in rows]
    h = spark.createDataFrame(rows, "level int, id string, community string, parent string")
    assert sorted((r.level, r.community) for r in G.falling_apart(e, h).collect()) == [(0, "c"), (1, "c")]
    assert G.falling_apart(e, h.where("id < 'c'")).count() == 0
