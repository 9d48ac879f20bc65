"""Cases of round 3's findings."""

import numpy as np
from pyspark.sql import functions as F


def _recall(spark, x, k=20):
    from loomgraph.llm import ann

    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hits / (k * len(range(0, len(x), 20)))


def test_ann_of_vectors_around_one_direction(spark):
    """the codes' error lies along the direction that all queries share, so short lists by codes alone missed most."""
    x = 1 + 0.05 * np.random.default_rng(1).normal(size=(8000, 64))
    assert _recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.9


def test_within_budget_counts_equals_together(spark):
    """rows that the order leaves equal pass the budget together, as in SQL."""
    from loomgraph.operators import relational as RL

    d = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (1, 2, 3.0), (1, 3, 1.0), (2, 1, 9.0), (2, 1, 9.0)], "g int, o int, v double")
    d.createOrReplaceTempView("budgeted")
    want = spark.sql("SELECT g, o FROM (SELECT *, sum(v) OVER (PARTITION BY g ORDER BY o) AS running, row_number() OVER (PARTITION BY g ORDER BY o) AS place FROM budgeted) WHERE running <= 7 OR place = 1")
    got = RL.within_budget(d, ["g"], [F.col("o")], F.col("v"), 7, True).select("g", "o")
    assert sorted(got.collect()) == sorted(want.collect()) == [(1, 1), (2, 1)]


def test_conversation_stream_of_a_folder(spark, tmp_path):
    """F8: a table of several files, as larger ones are."""
    from loomgraph.queries import QUERIES

    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"Said Berlin and Paris{c}") for c in range(6) for t in range(3)]
    shape = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["conversation_stream"](spark, f"{tmp_path}/many").collect())
    want = sorted(tuple(r) for r in QUERIES["conversation_memory"](spark, f"{tmp_path}/many").collect())
    assert got == want and len(got) == 6


def test_betweenness_and_closeness_of_a_larger_graph(spark):
    """more than a word of searches at once, and the same shares of paths held in tasks as by joins."""
    from loomgraph.operators import graph as G

    rng = np.random.default_rng(4)
    e = [(f"v{a}", f"v{b}", 1.0) for a, b in rng.integers(0, 300, (420, 2)).tolist()]
    v = spark.createDataFrame([(f"v{i}",) for i in range(302)], "id string")
    edges = G.cut(G.simple(spark.createDataFrame(e, "src string, dst string, weight double")))
    held, joined = ({r.id: round(r.betweenness, 9) for r in G.betweenness(edges, v, pivots=60, sent=n, block=60).collect()} for n in (10**6, 0))
    assert held == joined and any(held.values())
    near = {}
    for a, b, _ in edges.collect():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for r in G.closeness(edges, v).collect():
        far, order = {r.id: 0}, [r.id]
        for x in order:
            for y in near.get(x, ()):
                if y not in far:
                    far[y] = far[x] + 1
                    order.append(y)
        reached, total = len(far) - 1, sum(far.values())
        assert abs(r.closeness - (reached / total * reached / 301 if total else 0)) < 1e-9 and r.eccentricity == max(far.values())


def test_knn_sends_on_the_best_of_a_task(spark):
    """what a task holds and sends is bounded by its queries, however many rows and batches it has."""
    from loomgraph.operators import retrieval as R

    x = np.random.default_rng(5).normal(size=(1500, 4)).round(1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = R.knn(d, d.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    length = np.sqrt((x * x).sum(1))
    for q in range(0, 1500, 50):
        s = np.round(np.divide(x @ x[q], length * length[q], out=np.full(1500, -np.inf), where=length > 0), 12)
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.lexsort((np.arange(1500), -s))[:3].tolist()


def test_pairs_of_names_are_judged_where_they_meet(spark):
    """the pairs that go on from a band are those that are alike; none of them is lost."""
    from loomgraph.functions.text import char_shingles
    from loomgraph.operators import similarity as S

    rng = np.random.default_rng(6)
    stems = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(40)]
    names = sorted({s[:i] + c + s[i:] for s in stems for i in (0, 6, 12) for c in "xyz"} | set(stems))
    sets = {n: {n[i : i + 3] for i in range(len(n) - 2)} for n in names}
    like = {(a, b) for a in names for b in names if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    d = spark.createDataFrame([(n,) for n in names], "id string")
    got = {(r.a, r.b) for r in S.similar_pairs(d, "id", char_shingles(F.col("id")), 0.7).collect()}
    assert got <= like and len(got) >= 0.99 * len(like)
    linked = {(r.a, r.b) for r in S.linked_pairs(d, "id", char_shingles(F.col("id")), 0.7).collect()}
    assert linked <= like and {b for _, b in linked} == {b for _, b in got}
