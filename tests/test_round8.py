"""Text files that are written, found and decoded."""

from pathlib import Path

import numpy as np
import pandas as pd

import __spark_entry__ as entry
from loomgraph.operators import graph as G
from loomgraph.sources import readers


def test_text_files_are_written_and_found(spark, tmp_path, monkeypatch):
    """each document is a file, whatever its name, and is found by the scan of the folder."""
    rows = [("1", "one\n"), ("1", "one more"), ("1", "one\n"), ("../a b/%2F+*", "﻿marked"), ("", "no name"), (".hidden", "x"), ("é" * 300, "long"), ("2", " \n"), ("3", None), (None, "y")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    found = []
    load = readers.load
    monkeypatch.setattr(readers, "load", lambda s, at: found.append(at) or load(s, at))
    got = sorted(map(tuple, entry.queries()["text_files"](spark, str(tmp_path / "in")).collect()))
    assert got == sorted((n + ".txt", t) for n, t in rows if n is not None and t and t.strip())
    assert len(list(Path(found[0].removeprefix("file:").replace("///", "/")).rglob("*.txt"))) == 9


def test_hidden_folders_above(spark, tmp_path):
    """what lies in a hidden folder above the one that is read doesn't count as hidden."""
    at = tmp_path / ".kept" / "in"
    (at / ".git").mkdir(parents=True)
    for name in ("a.txt", "b.json", ".git/c.txt"):
        (at / name).write_text('{"page_content": "x"}')
    docs, failed = readers.load(spark, str(at))
    assert sorted(r.suffix for r in docs.collect()) == ["json", "txt"] and failed.count() == 0


def test_searches_leave_out_indexes_that_they_do_not_read(spark, tmp_path, monkeypatch):
    """A search whose unread indexes are left out never asks for them, and they can follow."""
    from loomgraph.plans.engine import Engine
    from loomgraph.queries import UNREAD

    e = Engine(spark, str(tmp_path))
    e.ingest(spark.createDataFrame([(1, "Castles guarded armies. Castles housed soldiers."), (2, "Armies crossed rivers near castles.")], "doc_id int, text string"), leave=UNREAD["hybrid"])
    assert e.index("entities") and not e.index("text_units")
    asked, index = [], e.index
    monkeypatch.setattr(e, "index", lambda kind: asked.append(kind) or index(kind))
    found = e.search("hybrid", ["what links castles and armies?"], 5).collect()
    assert found and set(asked) == {"entities", "relation_names"}
    e.index_also(("text_units",))
    assert index("text_units") and e._indexed() == {"entities", "relation_names", "text_units"} and not e._left & {"indexes.text_units"}
    assert e.search("hybrid", ["what links castles and armies?"], 5).collect() == found


def test_closeness_of_leaves_chains_and_hubs(spark):
    """leaves are told from what they hang on, chains and hubs are searched alike, all as by a search from each vertex."""
    e = [("hub", f"l{i}") for i in range(9)] + [("hub", "c0")] + [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("p", "q"), ("c12", "c5"), ("s", "s1"), ("s", "s2")]
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    near["alone"] = set()

    def far(v):
        at = {v: 0}
        front = [v]
        for x in front:
            for y in near[x]:
                if y not in at:
                    at[y] = at[x] + 1
                    front.append(y)
        return at

    n, want = len(near), {}
    for v in near:
        at = far(v)
        total, reached = sum(at.values()), len(at) - 1
        want[v] = (round(reached / max(1, total) * reached / (n - 1), 12), max(at.values()))
    edges = spark.createDataFrame([(*x, 1.0) for x in e], "src string, dst string, weight double")
    vertices = spark.createDataFrame([(v,) for v in near], "id string")
    got = {r.id: (round(r.closeness, 12), r.eccentricity) for r in G.closeness(edges, vertices).collect()}
    assert got == want
    adjacent, first, order = G._renumbered(*G._adjacency(G.cut(edges), "string")[1])
    size = np.diff(np.append(first, len(adjacent)))
    leaves = G._far(pd.DataFrame({"at": np.flatnonzero(size > 1)}), adjacent, first, n)
    assert len(leaves) == n - 3 and sorted(order) == list(range(n - 1))  # without p, q and alone
