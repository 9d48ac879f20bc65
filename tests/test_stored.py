"""The stored index, two writers, durable model calls, refined communities and reports from the finest level up."""

import json
import math
import random
import re
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.plans import durable
from loomgraph.plans import reports as P
from loomgraph.plans.engine import Engine
from loomgraph.plans.extract import Models
from loomgraph.plans.strategies import STRATEGIES
from loomgraph.sources.inverted import InvertedIndex
from loomgraph.sources.writers import Conflict, Store


def bm25(texts, queries, k, only=None):
    """The definition, over plain lists."""
    w = {i: re.findall(r"\w+", (x or "").lower()) for i, x in texts.items()}
    n, average = len(w), max(1, sum(map(len, w.values()))) / len(w)
    out = []
    for q, terms in queries.items():
        score = {}
        for t in set(re.findall(r"\w+", terms.lower())):
            df = sum(t in x for x in w.values())
            for i, x in w.items():
                if tf := x.count(t):
                    score[i] = score.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / average))
        best = sorted((-round(s, 9), i) for i, s in score.items() if only is None or (q, i) in only)
        out += [(q, i, round(-s, 6)) for s, i in best[:k]]
    return sorted(out)


def test_inverted_index(spark, tmp_path):
    rnd = random.Random(5)
    vocab = [f"t{i}" for i in range(60)]
    text = lambda: " ".join(vocab[min(59, int(rnd.paretovariate(0.6)) - 1)] for _ in range(rnd.randint(1, 40)))
    texts = {f"d{i}": text() for i in range(300)} | {"x1": None, "x2": "", "x3": "t0 " * 5000}
    queries = {"a": "t0 t3 t9", "b": "t1 T1 t40", "c": "nothing here", "d": "t55 t2"}
    df = lambda t: spark.createDataFrame(list(t.items()), "id string, text string").repartition(3)
    asked = spark.createDataFrame([(q, t) for q, x in queries.items() for t in re.findall(r"\w+", x.lower())], "query_id string, term string")
    ix = InvertedIndex(Store(spark, str(tmp_path / "s")), "docs", shard=8, first=3)
    found = lambda **o: sorted((r.query_id, r.id, round(r.score, 6)) for r in ix.search(asked, 10, **o).collect())
    ix.build(df(texts))
    opened = []
    assert found(opened=opened) == bm25(texts, queries, 10)
    assert opened[1] < opened[0]  # blocks were skipped
    only = spark.createDataFrame([(q, f"d{i}") for q in "abd" for i in range(0, 300, 7)], "query_id string, id string")
    assert found(only=only) == bm25(texts, queries, 10, {(q, f"d{i}") for q in "abd" for i in range(0, 300, 7)})
    gone = {i: x for n, (i, x) in enumerate(texts.items()) if n % 3 == 0}
    ix.remove(df(gone))
    left = {i: x for i, x in texts.items() if i not in gone}
    assert found() == bm25(left, queries, 10)
    back = {i: text() for i in gone} | {"new": "t9 t9 t9"}
    ix.add(df(back))
    assert found() == bm25(left | back, queries, 10)
    ix.remove(df({"new": "t9 t9 t9"}))
    ix.merge()
    assert len(ix.segments()) == 1 and found() == bm25(left | {i: back[i] for i in gone}, queries, 10)
    none = InvertedIndex(ix.store, "none")
    none.build(spark.createDataFrame([], "id string, text string"))
    assert none.exists and none.search(asked, 5).count() == 0


def test_searches_read_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"castles number{i} guard kingdoms{i % 5}") for i in range(40)], "doc_id string, text string")
    e = Engine(spark, str(tmp_path / "kg"), claims=False, levels=2)
    e.ingest(docs)
    asked = spark.createDataFrame([("q", "castles"), ("q", "kingdoms3")], "query_id string, term string")
    plan = e.index("text_units").search(asked, 5)._jdf.queryExecution().toString()
    assert "text_units/" not in plan and "text#" not in plan
    shown = e.store.lookup("text_units", spark.createDataFrame([(e.text_units.first().id,)], "id string"))
    plan = shown._jdf.queryExecution().toString()
    assert shown.count() == 1 and ("In(id" in plan or "EqualTo(id" in plan)
    # Static selection: the reports of a global search by their rank.
    q = spark.createDataFrame([("q", "castles kingdoms3 overview")], "query_id string, query string")
    rep = STRATEGIES["global"](e, q, 3, dynamic=False)[0].orderBy(F.desc("score")).collect()
    rank = {r.id: r["rank"] for r in e.reports.collect()}
    assert rep and [rank[r.id] for r in rep] == sorted((rank[r.id] for r in rep), reverse=True)


# --- two writers ------------------------------------------------------------------------------------------------------


def test_two_writers(spark, tmp_path):
    """A writer that began before another finished works on what that one left; no folder of another is removed."""
    store = lambda: Store(spark, str(tmp_path / "s"), buckets=4)
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id string, v string")
    store().replace("t", rows("0"))
    slow, fast = store(), store()
    write, waited = slow._write, []

    def late(*a):
        out = write(*a)
        if not waited:
            waited.append(1)
            fast.upsert("t", rows("1"))
        return out

    slow._write = late
    slow.upsert("t", rows("2"))
    assert {r.id for r in store().read("t").collect()} == {"0", "1", "2"}
    with pytest.raises(Conflict):
        slow._point("t", slow._manifest("t"), 1, 1)
    jobs = [threading.Thread(target=lambda i=i: store().upsert("t", rows(str(i)))) for i in range(10, 14)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert {r.id for r in store().read("t").collect()} == {"0", "1", "2", "10", "11", "12", "13"}


def test_buckets_follow_bytes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), buckets=2, target=4096)
    rnd = random.Random(1)
    d = spark.createDataFrame([(str(i), "".join(rnd.choices("abcdefghij", k=400))) for i in range(600)], "id string, v string")
    assert s.replace("t", d) == 600 and s._manifest("t")["buckets"] > 8
    assert s.upsert("t", spark.createDataFrame([("5", "x")], "id string, v string")) == 600
    assert s.lookup("t", spark.createDataFrame([("5",), ("77",), ("none",)], "k string")).count() == 2


# --- models -----------------------------------------------------------------------------------------------------------


def test_calls_keep_order_and_limits():
    seen = []

    def call(prompts):
        seen.append(len(prompts))
        if len(prompts) > 1 and "bad" in prompts or prompts == ["bad"]:
            raise RuntimeError("no")
        if "slow" in prompts:
            time.sleep(1.0)
        return [p.upper() for p in prompts]

    keys = list(range(7))
    df = pd.DataFrame({"key": keys, "prompt": ["a", "b", "bad", "c", "slow", "d", "e"]})
    began = time.time()
    out = next(iter(durable.calls(call, durable.Limits(batch=3, at_once=2, seconds=0.2, tries=2, pause=0.01))(iter([df]))))
    assert list(out["key"]) == keys and list(out["reply"]) == ["A", "B", None, "C", None, "D", "E"]
    assert list(out["error"])[2].startswith("RuntimeError") and "0.2 s" in list(out["error"])[4] and time.time() - began < 5


def _counting(folder, reply):
    """A model that notes each prompt in a file of its own."""

    def call(prompts):
        import os
        import uuid

        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                f.write(p)
        return [reply(p) for p in prompts]

    return call


def test_one_call_for_each_text(spark, tmp_path):
    """Over an ingest, an update and a rerun, a model is asked once for each distinct text."""
    asked, embedded = tmp_path / "asked", tmp_path / "embedded"
    asked.mkdir()
    embedded.mkdir()

    def reply(p):
        w = sorted(set(re.findall(r"[a-z]{6,}", p.rsplit("\n", 1)[-1])))
        return json.dumps({"entities": [{"name": x, "type": "T", "description": ""} for x in w], "relations": [{"source": a, "target": b, "type": "R", "description": ""} for a, b in zip(w, w[1:], strict=False)]})

    def engine(name):
        e = Engine(spark, str(tmp_path / name), claims=False, levels=1)
        e.models = Models(
            extract=durable.extractor(durable.Replies(e.store, "m1", _counting(str(asked), reply))),
            embed=durable.Embedder(e.store, "m2", _counting(str(embedded), lambda p: [float(len(p)), 1.0]), 2),
        )
        return e

    texts = {"0": "castles guard kingdoms", "1": "monkeys crossed bridges", "2": "castles guard kingdoms"}
    df = lambda t: spark.createDataFrame(list(t.items()), "doc_id string, text string")
    e = engine("kg")
    e.ingest(df(texts))
    prompts = lambda: [p.read_text(encoding="utf-8").rsplit("\n", 1)[-1] for p in asked.iterdir()]
    assert sorted(prompts()) == sorted(set(texts.values()))
    assert {r.name for r in e.entities.collect()} == {"castles", "kingdoms", "monkeys", "crossed", "bridges"} and e.edges.count() == 3
    texts |= {"3": "winter castles freeze", "1": "monkeys crossed rivers"}
    e.update(df(texts))
    e.ingest(df(texts))
    assert sorted(prompts()) == sorted({*texts.values(), "monkeys crossed bridges"})
    vectors = [p.read_text(encoding="utf-8") for p in embedded.iterdir()]
    assert len(vectors) == len(set(vectors)) > 5


def test_replies_that_fail_are_asked_again(spark, tmp_path):
    flag = tmp_path / "up"

    def call(prompts):
        import os

        if not os.path.exists(str(flag)):
            raise OSError("down")
        return [p[::-1] for p in prompts]

    r = durable.Replies(Store(spark, str(tmp_path / "s")), "m/1", call, limits=durable.Limits(tries=1, pause=0.0))
    rows = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "key int, prompt string")
    assert {(x.key, x.reply, (x.error or "")[:7]) for x in r.ask(rows).collect()} == {(1, None, "OSError"), (2, None, "OSError"), (3, None, "")}
    flag.write_text("")
    assert {(x.key, x.reply, x.error) for x in r.ask(rows).collect()} == {(1, "cba", None), (2, "cba", None), (3, None, None)}


# --- communities and reports ------------------------------------------------------------------------------------------


def ring_of_cliques(spark, n=6, size=5):
    e = [(c * 10 + a, c * 10 + b, 1.0) for c in range(n) for a in range(size) for b in range(a + 1, size)]
    e += [(c * 10, ((c + 1) % n) * 10 + 1, 1.0) for c in range(n)]
    v = sorted({x for p in e for x in p[:2]})
    return spark.createDataFrame(e, "src long, dst long, weight double"), spark.createDataFrame([(x,) for x in v], "id long")


def test_refined_communities(spark):
    e, v = ring_of_cliques(spark)
    e, v = G.cut(G.simple(e)), G.cut(v)
    h = G.cut(G.communities(e, v))
    zero = h.where("level = 0").select("id", "community")
    groups = {}
    for r in zero.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[c * 10 + i for i in range(5)] for c in range(6)]
    # A partition that took two far cliques for one is parted, and a clique that was cut in two comes together again.
    bad = v.select("id", F.when(F.col("id") < 5, 0).when(F.col("id").between(30, 34), 0).when(F.col("id").isin(10, 11), 10).otherwise(F.floor(F.col("id") / 10) * 10 + 3).cast("long").alias("community"))
    apart = G.hanging_together(e, bad)
    assert apart.where("id = 30").first().community == 30
    better = G.refined(e, v, bad)
    q = lambda x: G.modularity(e, x).first()[0]
    assert q(better) >= q(apart) >= q(bad)
    for level in {r.level for r in h.collect()}:
        labels = h.where(F.col("level") == level).select("id", "community")
        assert G.hanging_together(e, labels).select("community").distinct().count() == labels.select("community").distinct().count()


def test_reports_from_the_finest_level_up(spark):
    rows = [(0, i, i // 3 * 3, 0) for i in range(9)] + [(1, i, 0, None) for i in range(9)]
    h = spark.createDataFrame(rows, "level int, id long, community long, parent long").select("level", F.format_string("n%d", "id").alias("id"), F.format_string("c%d", "community").alias("community"), F.when(F.col("parent").isNotNull(), F.format_string("c%d", "parent")).alias("parent"))
    ents = spark.createDataFrame([(f"n{i}", f"name{i}", "T", "word " * 20, [f"u{i}"]) for i in range(9)], "id string, name string, type string, description string, text_unit_ids array<string>")
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "R", "", 1.0) for i in range(8)], "id string, source_id string, target_id string, type string, description string, weight double")
    wide = {(r.level, r.community_id): r for r in P.bottom_up(h, edges, ents).collect()}
    assert set(wide) == {(0, "c0"), (0, "c3"), (0, "c6"), (1, "c0")} and len({r.id for r in wide.values()}) == 4
    assert "Groups within" not in wide[1, "c0"].full_content and wide[1, "c0"].size == 9
    tight = {(r.level, r.community_id): r for r in P.bottom_up(h, edges, ents, budget=60).collect()}
    body = tight[1, "c0"].full_content
    assert "Groups within" in body and all(tight[0, c].name in body for c in ("c0", "c3"))
    assert "Groups within" not in tight[0, "c3"].full_content
    assert [r.id for r in P.selected(spark.createDataFrame([("a", 1, 2.0), ("b", None, 9.0), ("c", 1, 3.0)], "id string, rank int, rating double"), 2).collect()] == ["c", "a"]
