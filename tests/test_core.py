"""Operators on small tables with known results."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import identity as ID
from loomgraph.functions import text as T
from loomgraph.functions import values as V
from loomgraph.operators import evaluate as E
from loomgraph.operators import graph as G
from loomgraph.operators import relational as RL
from loomgraph.operators import retrieval as R
from loomgraph.operators import similarity as S
from loomgraph.plans import chunking, extract
from loomgraph.plans.engine import Engine
from loomgraph.plans.strategies import STRATEGIES, strategy
from loomgraph.sources import readers, writers
from loomgraph.streaming import incremental as I
from loomgraph.streaming.memory import remember


def one(spark, column, **values):
    """A column's value over one row of named values."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x string")
    return row.select(column.alias("out")).first()[0]


def texts(spark, f, *xs):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in d.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


# --- functions --------------------------------------------------------------------------------------------------------


def test_normalize_name(spark):
    given = ["Loom", "LOOM", "Warp-Weft", "warp_weft", "\tLoom ", "ＬＯＯＭ", "Señor", "大阪", "??", "Maß", "Iron-Works", None]
    assert texts(spark, T.normalize_name, *given) == ["loom", "loom", "warp weft", "warp weft", "loom", "loom", "señor", "大阪", "??", "mass", "iron works", None]


def test_token_estimates(spark):
    assert texts(spark, T.estimate_tokens, "", "a b c", "abcdefghijklmnop", "東京都", None) == [0, 3, 4, 3, 0]


def test_grounding(spark):
    g = lambda s, c: one(spark, T.is_grounded(F.col("s"), F.col("c")), s=s, c=c)
    assert g("", "x") and g("two words", "nothing of that")
    assert g("the quick brown fox", "see the quick brown fox run")
    assert g("the quick brown fox jumps", "quick fox brown jumps")
    assert not g("one two three four five", "six seven eight")


def test_names(spark):
    assert texts(spark, T.acronym, "World Health Organization", "single", "a1 b2") == ["WHO", None, None]
    assert texts(spark, T.capitals, "McDonald", "plain") == ["MD", None]
    assert one(spark, T.containment(F.col("a"), F.col("b")), a="abc", b="abcdef") == 0.5
    assert one(spark, T.sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == 0.75
    assert texts(spark, T.char_shingles, "abcd", "ab") == [["abc", "bcd"], ["ab"]]
    assert one(spark, T.phrase_in(F.col("p"), F.col("t")), p="Acme Corp", t="He left (Acme Corp).")
    assert not one(spark, T.phrase_in(F.col("p"), F.col("t")), p="me Corp", t="Acme Corp")
    assert one(spark, T.phrase_in(F.col("p"), F.col("t")), p="東京", t="これは東京です")
    assert texts(spark, T.parse_strategy, "GLOBAL", "use drift here", "none") == ["global", "drift", "local"]
    assert one(spark, T.is_refusal(F.col("a"), F.col("q")), a="I cannot translate", q="x")


def test_identities(spark):
    name = "entity:東京"
    assert one(spark, ID.stable_id(F.col("x")), x=name) == str(uuid.uuid5(ID.NAMESPACE, name))
    assert texts(spark, ID.path_id, "./a/b.txt", "a\\b.txt")[0] == texts(spark, ID.path_id, "a/b.txt")[0]
    with pytest.raises(ValueError):
        ID.check_suffix("No Good")


def test_values(spark):
    assert texts(spark, V.confidence, "0.5", "8", "20", "x", "-1") == [0.5, 0.8, 1.0, 1.0, 0.0]
    assert texts(spark, V.rating, "8.5 of 10", "none", "99") == [8.5, 0.0, 10.0]
    assert texts(spark, V.map_score, "55.9", "NaN", "1e99", "-3") == [55, 0, 100, 0]
    assert texts(spark, V.judge_score, '{"score": 0.7}', "0.4", "1 or 2") == [0.7, 0.4, 0.0]
    assert texts(spark, V.json_object, '```json\n{"a": 1}\n```', "no") == ['{"a": 1}', "{}"]
    got = texts(spark, V.map_points, 'x {"points": [{"description": "a", "score": 5}, {"description": "b", "score": "90"}, {"description": "c", "score": 0}]}')[0]
    assert [(p.description, p.score) for p in got] == [("b", 90), ("a", 5)]
    got = texts(spark, V.xml_findings, "<finding><summary>s</summary><explanation>e</explanation></finding><finding><summary>t</summary>")[0]
    assert [(p.summary, p.explanation) for p in got] == [("s", "e"), ("t", "")]
    assert texts(spark, V.ensure_list, '["a", "b"]', "a", "", None) == [["a", "b"], ["a"], [], []]


# --- relational -------------------------------------------------------------------------------------------------------

EDGES = "id string, source_id string, target_id string, type string, weight double, text_unit_ids array<string>, ord int, description string"


def test_merges(spark):
    e = spark.createDataFrame([("r1", "e1", "e2", "T", 1.0, ["t1"], 1, "a"), ("r2", "e1", "e2", " t ", 3.0, ["t2", "t1"], 2, "b"), ("r3", "e2", "e3", "T", 5.0, ["t1"], 3, "c")], EDGES)
    got = {r.id: r for r in RL.merge_resolved_edges(e).collect()}
    assert (got["r1"].weight, got["r1"].text_unit_ids, got["r3"].weight) == (2.0, ["t1", "t2"], 5.0)
    assert {r.id: r.weight for r in RL.merge_resolved_edges(e, always=True).collect()} == {"r1": 2.0, "r3": 1.0}
    twice = RL.merge_resolved_edges(e.union(e), always=True)
    assert {r.id: r.weight for r in twice.collect()} == {"r1": 2.0, "r3": 1.0}
    remap = spark.createDataFrame([("e3", "e2")], "old string, new string")
    assert [r.id for r in RL.remap_edges(e, remap).orderBy("id").collect()] == ["r1", "r2"]
    ents = spark.createDataFrame([("a", "Acme", ["t1"], 0.5, 0), ("b", "ACME", ["t2"], 0.9, 1), ("c", "Bold", ["t3"], 0.1, 2)], "id string, name string, text_unit_ids array<string>, confidence double, src int")
    merged, mapping = RL.merge_incremental(ents.where("src = 0").drop("src"), ents.where("src > 0").drop("src"), T.normalize_name("name"))
    assert {(r.id, r.frequency, r.confidence) for r in merged.collect()} == {("a", 2, 0.9), ("c", 1, 0.1)}
    assert {tuple(r) for r in mapping.collect()} == {("b", "a"), ("c", "c")}


def test_filters_and_budgets(spark):
    d = spark.createDataFrame([(1, "a", 5.0), (2, "b", 15.0), (3, "a", 25.0)], "id int, k string, v double")
    assert [r.id for r in d.where(RL.filter_map({"k": ["a"], "v": {"gte": 10}})).collect()] == [3]
    assert [r.id for r in RL.within_budget(d, [], [F.col("id")], F.col("v"), 20).collect()] == [1, 2]
    assert [r.id for r in RL.within_budget(d, [], [F.col("id")], F.col("v"), 1, first_anyway=True).collect()] == [1]
    assert one(spark, RL.content(F.col("a"), F.col("b"), F.col("c")), a="x", b=None, c="x") == "x"
    s = RL.metric_statistics(spark.createDataFrame([("m", 1.0), ("m", 3.0), ("n", 2.0), ("n", float("nan"))], "metric string, value double"), "metric", "value").orderBy("metric").collect()
    assert (s[0]["mean"], round(s[0]["stdev"], 6), s[1]["stdev"], s[1]["n"]) == (2.0, 1.414214, 0.0, 1)


# --- retrieval --------------------------------------------------------------------------------------------------------

RESULTS = "query_id string, bucket string, source string, content string, score double"


def test_fusion(spark):
    r = spark.createDataFrame([("q", "a", "s1", "x", 9.0), ("q", "a", "s2", "y", 5.0), ("q", "b", "s1", "x", 1.0)], RESULTS)
    got = {x.source: x.score for x in R.rank_fusion(r).collect()}
    assert got["s1"] == pytest.approx(2 / 61) and got["s2"] == pytest.approx(1 / 62)
    got = {x.source: x.score for x in R.rank_fusion(r, {"a": 3.0}).collect()}
    assert got["s1"] == pytest.approx(4 / 61)
    m = spark.createDataFrame([("q", 10.0), ("q", 20.0), ("q", 15.0), ("p", 3.0), ("p", 3.0)], "query_id string, score double")
    assert sorted(x.score for x in R.min_max(m, ["query_id"]).collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        R.hybrid(m, m, (0.5, 0.6))


def test_diversity_and_packing(spark):
    r = spark.createDataFrame([("q", "1", 1.0, "a b c"), ("q", "2", 0.9, "a b c"), ("q", "3", 0.5, "x y z")], "query_id string, key string, score double, content string")
    assert sorted(x.key for x in R.diverse(r, 2).collect()) == ["1", "3"]
    assert R.diverse(r, 2, 1.0).count() == 3
    s = spark.createDataFrame([("q", "a", 600, 3.0), ("q", "b", 100, 2.0), ("q", "c", 0, 9.0), ("q", "d", 80, 1.0)], "query_id string, key string, tokens long, priority double")
    assert sorted(x.key for x in R.pack(s, 512 + 190).collect()) == ["b", "d"]
    assert R.pack(s, 100).count() == 0
    assert one(spark, R.section_priority(F.col("s"), F.col("k")), s=0.0, k="TEXT") == 0.65


def test_fuzzy(spark):
    v = spark.createDataFrame([("house",), ("mouse",), ("houses",), ("hx",)], "term string")
    q = spark.createDataFrame([("q", "house")], "query_id string, term string")
    assert {r.term for r in R.fuzzy_terms(v, q).collect()} == {"house", "mouse", "houses"}


def test_fuzzy_loses_nothing(spark):
    """All terms within the edits allowed, also with changes at both ends, against a plain distance."""
    import random

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 8)))
    v, q = sorted({word() for _ in range(300)} | {"ttatiok"}), ["station", *{word() for _ in range(30)}]
    got = {(r.query_id, r.term) for r in R.fuzzy_terms(spark.createDataFrame([(x,) for x in v], "term string"), spark.createDataFrame([(x, x) for x in q], "query_id string, term string")).collect()}
    most = lambda x: 0 if len(x) < 3 else 1 if len(x) < 6 else 2
    assert got == {(x, y) for x in q for y in v if far(x, y) <= most(x)} | {(x, x) for x in q}


def test_knn(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (200, 5)).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 5), (902, [1.0, 2.0])]
    v = spark.createDataFrame(data, "id long, v array<double>").repartition(3)
    q = v.where("id % 9 = 0").select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.col("v").alias("q"))
    got = {}
    for r in R.knn(v, q, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    norm = np.linalg.norm(x, axis=1)
    for i in range(0, 200, 9):
        if norm[i]:
            ok = np.flatnonzero(norm > 0)
            score = np.round(x[ok] @ x[i] / norm[ok] / norm[i], 12)
            assert got[f"q{i}"] == ok[np.lexsort((ok, -score))][:4].tolist()


# --- graph ------------------------------------------------------------------------------------------------------------


def graph(spark, *pairs, more=()):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    v = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | set(more))], "id string")
    return G.simple(e), v


def test_centralities(spark):
    star = graph(spark, ("h", "a"), ("h", "b"), ("h", "c"))
    d = {r.id: r.centrality for r in G.degrees(*star).collect()}
    assert d["h"] == 1.0 and d["a"] == pytest.approx(1 / 3)
    assert {r.id: r.betweenness for r in G.betweenness(*star).collect()} == {"h": 1.0, "a": 0.0, "b": 0.0, "c": 0.0}
    assert {r.id: r.closeness for r in G.closeness(*star).collect()}["h"] == 1.0
    rank = {r.id: r["rank"] for r in G.pagerank(*star).collect()}
    assert sum(rank.values()) == pytest.approx(1.0) and rank["h"] == max(rank.values())
    lone = graph(spark, ("a", "b"), more=["z"])
    assert sum(r["rank"] for r in G.pagerank(*lone).collect()) == pytest.approx(1.0)
    x = {r.id: r.x for r in G.eigenvector(*graph(spark, ("a", "b"), ("b", "c"), ("a", "c"))).collect()}
    assert max(x.values()) == pytest.approx(min(x.values()))


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_closeness_of_every_vertex(spark, sent):
    e, v = graph(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), more=["z"])
    got = {r.id: (round(r.closeness, 9), r.eccentricity) for r in G.closeness(e, v, block=3, sent=sent).collect()}
    far = {"a": (3, 6, 3), "b": (3, 4, 2), "c": (3, 4, 2), "d": (3, 6, 3), "x": (1, 1, 1), "y": (1, 1, 1)}
    assert got == {k: (round(r / t * r / 6, 9), m) for k, (r, t, m) in far.items()} | {"z": (0.0, 0)}
    if sent:
        n = 2100
        ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1.0).alias("weight"))
        got = G.closeness(G.simple(ring), spark.range(n)).collect()
        assert len(got) == n and {r.eccentricity for r in got} == {n // 2}


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_betweenness(spark, sent):
    """The middle of a path and of a square with a tail, in tasks and as joins."""
    e, v = graph(spark, ("a", "b"), ("b", "c"), ("c", "d"), more=["z"])
    got = {r.id: round(r.betweenness * 4 * 3 / 2, 9) for r in G.betweenness(e, v, sent=sent, block=2).collect()}
    assert got == {"a": 0, "b": 2, "c": 2, "d": 0, "z": 0}
    e, v = graph(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "t"))
    got = {r.id: round(r.betweenness * 4 * 3 / 2, 9) for r in G.betweenness(e, v, sent=sent, block=3).collect()}
    assert got == {"a": 1, "b": 0.5, "c": 1, "d": 3.5, "t": 0}


def test_k_hop_of_each_query_alone(spark):
    e, v = graph(spark, *[("h", f"n{i}") for i in range(9)], ("x", "y"))
    seeds = spark.createDataFrame([("p", "h"), ("q", "x"), ("r", "h")], "query_id string, id string")
    got = sorted((r.query_id, r.id) for r in G.k_hop(e, seeds, 1, 4, by=("query_id",)).collect())
    assert got == [(q, f"n{i}") for q in "p" for i in range(4)] + [("q", "y")] + [("r", f"n{i}") for i in range(4)]


def test_structure(spark):
    e, v = graph(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), more=["z"])
    assert {r.id: r.component for r in G.components(e, v).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}
    c = {r.id: r.clustering for r in G.clustering(e, v).collect()}
    assert c["a"] == 1.0 and c["c"] == pytest.approx(1 / 3) and c["z"] == 0.0
    s = G.statistics(e, v).first()
    assert (s.nodes, s.edges, s.components, s.largest) == (7, 5, 3, 4)
    hops = {r.id: r.hop for r in G.k_hop(e, v.where("id = 'd'"), 2).collect()}
    assert hops == {"c": 1, "a": 2, "b": 2, "d": 2}


def test_communities(spark):
    clique = [(a, b) for a in "abcde" for b in "abcde" if a < b]
    e, v = graph(spark, *clique, ("z", "a"))
    got = {r.id: r.community for r in G.communities(e, v).where("level = 0").collect()}
    assert len(set(got.values())) == 1 and len(got) == 6
    e, v = graph(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"), more=["lone"])
    got = {r.id: r.community for r in G.communities(e, v).where("level = 0").collect()}
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "def"}) == 1 and got["a"] != got["d"] and got["lone"] == "lone"
    labels = v.select("id", F.when(F.col("id").isin("a", "b", "c"), "1").otherwise("2").alias("community"))
    assert G.modularity(e, labels).first()[0] > 0.3
    assert G.coarsen(e, labels).first().weight == 1.0
    assert G.best_resolution(e, v) > 0


# --- similarity -------------------------------------------------------------------------------------------------------


def test_similarity(spark):
    names = ["international business machines", "international business machine", "acme corporation", "acme corporations", "zebra"]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    exact = {(r.a, r.b) for r in S.exact_pairs(d.withColumn("id", F.col("name")), "id", T.char_shingles(F.col("id")), 0.6).collect()}
    assert exact == {(r.a, r.b) for r in S.similar_pairs(d.withColumn("id", F.col("name")), "id", T.char_shingles(F.col("id")), 0.6).collect()} and len(exact) == 2
    got = {r.name: (r.match, r.score) for r in S.best_match(spark.createDataFrame([("IBM",), ("Acme Corporation",), ("ZEBRA",)], "name string"), spark.createDataFrame([("International Business Machines",), ("acme corporation",), ("zebra",)], "name string")).collect()}
    assert got == {"IBM": ("International Business Machines", 0.9), "Acme Corporation": ("acme corporation", 0.95), "ZEBRA": ("zebra", 0.95)}
    t = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, t), (2, t + " more"), (3, "something else entirely here"), (4, None)], "doc_id int, text string")
    assert [r.doc_id for r in S.drop_near_duplicates(docs, "doc_id", "text").orderBy("doc_id").collect()] == [1, 3, 4]


# --- chunking, sources, incremental, engine ---------------------------------------------------------------------------


def test_chunking(spark):
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(10))
    parts = chunking.split_recursive(text, 200, 20)
    assert all(len(p) <= 200 for p in parts) and set(text.split()) == {w for p in parts for w in p.split()}
    assert chunking.split_recursive("  ", 10, 0) == []
    assert "".join(chunking.split_recursive("x" * 25, 10, 0)) == "x" * 25
    assert chunking.merge_small(["a" * 5, "b" * 5, "c" * 50], 10, 20) == ["aaaaa\nbbbbb", "c" * 50]
    assert chunking.split_at_lines("a\nb\nc", [2]) == ["a", "b\nc"] and chunking.split_at_lines("a\nb", [9]) is None
    assert len(chunking.split_at_headers("# A\nx\n# B\ny", 100, 0, 0)) == 2
    d = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    assert chunking.chunk(d, size=200).where("number = 1").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    for name, b in {"a.txt": b"\xef\xbb\xbfhello", "b.md": "caf\xe9".encode("latin-1"), "c.html": b"<p>one</p><script>x</script><p>two &amp; three</p>", "d.json": b'{"pages": [{"text": "p1"}, {"text": "p2"}]}', "e.txt": b" ", "f.bin": b"x", ".hidden/g.txt": b"no"}.items():
        (tmp_path / "in" / name).write_bytes(b)
    docs, failed = readers.load(spark, str(tmp_path / "in"))
    got = {r.file_path.rsplit("/", 1)[1]: r.text for r in docs.collect()}
    assert got == {"a.txt": "hello", "b.md": "café", "c.html": "one\ntwo & three", "d.json": "p1\n\np2"}
    assert failed.count() == 1
    assert readers.fingerprint(spark, str(tmp_path / "in")) == readers.fingerprint(spark, str(tmp_path / "in"))
    (tmp_path / "q.json").write_text('[{"question": "a?", "answer": "b", "category": "c"}, {"query_id": "z"}, {"id": "y", "question": "d?"}]')
    q = readers.evaluation_set(spark, str(tmp_path / "q.json")).collect()
    assert [(r.query_id[:1], r.has_truth) for r in q] == [("q", True), ("y", False)]


def test_store_and_increments(spark, tmp_path):
    store = writers.Store(spark, str(tmp_path / "store"))
    d = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    assert store.replace("t", d) == 2 and store.upsert("t", spark.createDataFrame([("2", "c"), ("3", "d")], d.schema)) == 3
    assert {tuple(r) for r in store.read("t").collect()} == {("1", "a"), ("2", "c"), ("3", "d")}
    assert store.delete("t", spark.createDataFrame([("1",)], "id string")) == 2 and store.counts() == {"t": 2}
    assert store.verify(["t", "u"]) == ["u"]
    with pytest.raises(Exception, match="boom|error|ERROR|DIVIDE|USER"):
        store.replace("t", d.withColumn("v", F.raise_error(F.lit("boom")).cast("string")))
    assert store.counts() == {"t": 2}
    store.clear()
    assert store.names() == []
    assert writers.gate({"a": (0, 5), "b": (9, 1), "c": (0, 0), "d": (7, 3)}) == ["a", "d"]
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, text string")
    now = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "doc_id int, text string")
    assert {r.doc_id: r.change_type for r in I.diff(I.registry(docs), I.registry(now)).collect()} == {1: "deleted", 2: "unchanged", 3: "changed", 4: "new"}
    assert I.resume(["a"], ["a", "b", "c"]) == ["b", "c"] and I.resume([], ["a", "b"], "b") == ["b"]


def test_store_writes_what_it_touches(spark, tmp_path):
    """An upsert of one key leaves the other buckets' files; a write that breaks off leaves the table; the last manifest counts."""
    store = writers.Store(spark, str(tmp_path / "store"), buckets=16)
    d = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v"))
    store.replace("t", d)
    before = store._manifest("t")["folders"]
    assert store.upsert("t", spark.createDataFrame([("7", "new"), ("900", "new")], d.schema)) == 201
    after = store._manifest("t")["folders"]
    assert 1 <= sum(after[b] != v for b, v in before.items()) <= 2
    assert {r.id for r in store.read("t").where("v = 'new'").collect()} == {"7", "900"}
    assert store.delete("t", spark.createDataFrame([("7",), ("8",), ("none",)], "id string")) == 199
    with pytest.raises(Exception, match="boom|USER"):
        store.upsert("t", d.limit(3).withColumn("v", F.raise_error(F.lit("boom")).cast("string")))
    assert store.counts() == {"t": 199}
    more = spark.createDataFrame([("7", "x", 1)], "id string, v string, extra int")
    store.upsert("t", more)
    assert {(r.id, r.extra) for r in store.read("t").where("extra = 1").collect()} == {("7", 1)} and store.counts() == {"t": 200}
    assert store.delete("t", d.select(F.lit("old").alias("id")), "v") == 2
    store.replace("e", d.limit(0))
    assert store.read("e").columns == ["id", "v"] and store.read("e").count() == 0


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"search": {"k": 5}}')
    got = readers.configuration(str(tmp_path / "c.json"), {"search": {"k": 10, "name": "mix"}, "n": 1}, {"LOOMGRAPH__N": "7", "OTHER": "x", "LOOMGRAPH__SEARCH__NAME": "local"})
    assert got == {"search": {"k": 5, "name": "local"}, "n": 7}
    with pytest.raises(ValueError):
        readers.configuration(str(tmp_path / "c.json"), {"n": 1}, {})
    assert readers.parse_filter("a: b:c") == {"a": "b:c"}
    with pytest.raises(ValueError):
        readers.parse_filter("none")


def test_cache(spark, tmp_path):
    cache, made = writers.Cache(writers.Store(spark, str(tmp_path / "c")), hours=1), []

    def build():
        made.append(1)
        return spark.range(3)

    for content, now in (("a", 0.0), ("a", 60.0), ("b", 60.0), ("b", 4000.0)):
        assert cache.get("x", content, build, now).count() == 3
    assert len(made) == 3 and cache.statistics() == {"hits": 1, "misses": 3, "hit_rate": 0.25}


def test_stream(spark, tmp_path):
    schema = "id string, text string"
    spark.createDataFrame([("1", "a"), ("2", "b")], schema).write.parquet(str(tmp_path / "in" / "one"))
    store = writers.Store(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    q = I.watch(spark, str(tmp_path / "in" / "*"), schema, store, lambda b: {"t": b}, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert store.counts() == {"t": 2}


def test_memory_of_a_stream(spark, tmp_path):
    """The state gives the batch result after each run, with late turns, and silent conversations go by their timer."""
    schema = "conv_id long, turn int, role string, text string, extra string"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Anna met Peter{'xyzw'[t % 4]} and Paula{'abc'[c % 3]}, Anna", None) for c in range(4) for t in range(30)]
    rows += [(9, 1, "assistant", None, "x"), (9, 2, None, "", None)]
    late = [r for r in rows if r[0] == 2 and r[1] % 3 == 0] + [(7, 0, "user", "Only Étienne here", None)]
    first = [r for r in rows if r not in late]
    at, kept = str(tmp_path / "in"), writers.Store(spark, str(tmp_path / "store"))
    columns = ("conv_id", "messages", "mentioned", "focus", "last_turn")
    as_set = lambda df: {tuple(map(str, (r[c] for c in columns))) for r in df.collect()}
    for part, seen in ((first, first), (late, first + late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)
        remember(spark.readStream.schema(schema).parquet(at), kept, str(tmp_path / "cp")).awaitTermination(120)
        assert as_set(kept.read("memory")) == as_set(I.memory(spark.createDataFrame(seen, schema)))
    short = writers.Store(spark, str(tmp_path / "short"))
    for conv in (1, 2):
        spark.createDataFrame([(conv, 0, "user", "Martha", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
        remember(spark.readStream.schema(schema).parquet(str(tmp_path / "in2")), short, str(tmp_path / "cp2"), idle=1).awaitTermination(120)
    assert {r.conv_id for r in short.read("memory").collect()} <= {2}


def test_engine(spark, tmp_path):
    topics = ["quantum computers process information differently than classical machines", "medieval castles defended kingdoms against invading armies", "tropical rainforests shelter countless species of insects"]
    docs = spark.createDataFrame([(str(i), f"{topics[i % 3]}. {topics[i % 3].split()[i % 5]} number {i}.") for i in range(12)], "doc_id string, text string")
    e = Engine(spark, str(tmp_path / "kg"))
    counts = e.ingest(docs)
    assert counts["text_units"] == 12 and counts["entities"] > 5 and counts["reports"] >= 1
    for name in ("simple", "naive", "local", "global", "drift", "hybrid", "mix", "auto"):
        got = e.search(name, ["medieval castles and kingdoms of armies", "rainforests"], 3).collect()
        assert {r.query_id for r in got} == {"q_0", "q_1"}, name
        assert all(r["rank"] <= 3 for r in got)
    assert "medieval" in e.search("naive", ["medieval castles"], 1).first().content
    a = {r.query_id: r.answer for r in e.answer("naive", ["medieval castles", "zzzz"]).collect()}
    assert "castles" in a["q_0"] and a["q_1"] == "No relevant information found."
    again = e.update(docs.where("doc_id <> '0'").union(spark.createDataFrame([("20", topics[1] + ".")], docs.schema)))
    assert {r.doc_id: r.change_type for r in again.where("change_type <> 'unchanged'").collect()} == {"0": "deleted", "20": "new"}
    assert {r.document_id for r in e.text_units.collect()} == {*map(str, range(1, 12)), "20"}
    with pytest.raises(ValueError):
        strategy("simple")(STRATEGIES["simple"])


def test_search_of_one_query_is_that_of_a_batch(spark, tmp_path):
    """What a query finds doesn't depend on those asked beside it."""
    topics = ["quantum computers process information", "medieval castles defended kingdoms against armies", "tropical rainforests shelter canopy monkeys"]
    docs = spark.createDataFrame([(str(i), f"{topics[i % 3]}. {topics[i % 3].split()[i % 4]} number {i}.") for i in range(9)], "doc_id string, text string")
    e = Engine(spark, str(tmp_path / "kg"))
    e.ingest(docs)
    asked = {"a": "castles kingdoms", "b": "rainforests monkeys", "c": "quantum castles overview"}
    ask = lambda names: spark.createDataFrame([(n, asked[n]) for n in names], "query_id string, query string")
    for name in ("simple", "local", "global", "mix"):
        got = lambda q: sorted((r.query_id, r["rank"], r.source, round(r.score, 9)) for r in e.search(name, q, 5).collect())  # noqa: B023, E731
        assert [r for r in got(ask("abc")) if r[0] == "a"] == got(ask("a")), name
    assert not [r for r in e.search("local", ["castles"], 20).collect() if "monkeys" in r.content]


def test_update_is_a_full_ingest(spark, tmp_path):
    """Entities keep the text units of unchanged documents; updating twice is updating once; all tables are those of an ingest."""
    texts_ = ["castles and armies guard kingdoms", "castles shelter armies from winter", "monkeys cross canopy bridges", "castles of monkeys"]
    old = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts_)], "doc_id string, text string")
    new = spark.createDataFrame([("0", texts_[0]), ("1", "castles shelter nobody"), ("4", "bridges near castles"), ("5", "winter castles of kingdoms")], "doc_id string, text string")
    a, b = Engine(spark, str(tmp_path / "a"), levels=2), Engine(spark, str(tmp_path / "b"), levels=2)
    a.ingest(old)
    a.update(new)
    b.ingest(new)
    state = lambda e: (
        sorted((r.id, r.name, r.type, tuple(r.text_unit_ids), r.frequency) for r in e.entities.collect()), sorted((r.source_id, r.target_id, r.weight, tuple(r.text_unit_ids)) for r in e.edges.collect()),
        sorted((r.id, r.community) for r in e.labels.collect()), sorted(r.id for r in e.reports.collect()), sorted((r.kind, r.id) for r in e.store.read("vectors").collect()),
    )
    assert state(a) == state(b)
    for kind in ("text_units", "entities", "reports", "claims", "relation_names"):  # the stored indexes find what fresh ones do
        asked = spark.createDataFrame([("q", t) for t in ("castles", "winter", "monkeys", "bridges", "armies")], "query_id string, term string")
        got = [sorted((r.id, round(r.score, 9)) for r in e.index(kind).search(asked, 50).collect()) for e in (a, b)]
        assert got[0] == got[1], kind
    once = state(a)
    assert a.update(new).where("change_type <> 'unchanged'").count() == 0 and state(a) == once
    assert {r.name: r.frequency for r in a.entities.collect()}["castles"] == 4
    assert set(a.metrics) >= {"communities", "reports", "vectors"}


def test_models(spark):
    u = spark.createDataFrame([("d", 1, "Alpha meets gammas. Gammas helps deltas here."), ("d", 2, "gammas and deltas")], "document_id string, number int, text string")
    ents, edges = extract.extract_graph(u)
    assert {r.name for r in ents.collect()} == {"gammas", "deltas"} and edges.first().weight == 2.0
    assert extract.extract_claims(u, ents).count() == 2
    v = extract.embed(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, t string"), "t").orderBy("id").collect()
    assert v[0].embedding == v[1].embedding and sum(x * x for x in v[0].embedding) == pytest.approx(1.0)
    s = extract.summarise(spark.createDataFrame([("One two three. Four five six.",)], "description string"), above=3, most=4)
    assert s.first()[0] == "One two three."


def test_evaluation(spark):
    d = spark.createDataFrame([("q", "Acme hired Bob in Seattle", ["Acme", "Zed"], ["hired Bob"]), ("p", "x", [], [])], "query_id string, context string, expected_entities array<string>, expected_relationships array<string>")
    got = {r.query_id: (r.entity_coverage, r.relationship_coverage, r.overall) for r in E.coverage(d).collect()}
    assert got == {"q": (0.5, 1.0, 0.75), "p": (None, None, None)}
    assert "&lt;b&gt;" in E.html_table(spark.createDataFrame([("<b>",)], "x string"), "t")
