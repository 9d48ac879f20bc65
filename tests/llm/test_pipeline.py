"""The pipeline on small tables: every stage against a brute-force version of its input."""

import collections
import json
import random

import pytest
from test_operators import grouped, near

import corpus_pipeline
from loomgraph.llm import bpe, mixing, quality
from loomgraph.llm.common import Scratch


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    text = lambda: "\n".join(" ".join(rnd.choice(vocab) for _ in range(10)) for _ in range(8))
    docs, labels = [], []
    for i in range(200):
        bad = i % 4 == 1
        x = text()
        docs.append((i, x.upper() + " !!!" if bad else x, "en", f"src{i % 3}"))
        labels.append((i, int(not bad), 0))
    for i in range(200, 220):
        w = docs[2 * (i - 198)][1].split(" ")
        w[3] = "changed"
        docs.append((i, " ".join(w), "en", "src0"))
    docs += [(220, None, None, None), (221, "", "en", "src1"), (222, docs[2][1], "en", "src2"), (223, docs[4][1].replace("\n", " "), "en", "src2")]
    at = tmp_path_factory.mktemp("pipeline")
    d = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, states = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, folder))
        states.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    ids = [[r.doc_id for r in s] for s in states]
    assert not [i for i in ids[1] if i < 200 and i % 4 == 1]
    assert len([i for i in ids[1] if i < 200]) == 150
    assert 222 not in ids[2]  # an exact copy has lost all lines
    assert 220 in ids[4] and 221 in ids[4]
    assert len(ids[3]) == len(set(ids[3]))
    words = collections.Counter()
    for r in states[3]:
        words[r.source] += len((r.text or "").split())
    taken = collections.Counter()
    for r in states[4]:
        taken[r.source] += len((r.text or "").split())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())
    assert all(taken[s] <= 2 * words[s] for s in words)
    own = bpe.load(bpe.vocabulary_path())
    text = {r.doc_id: r.text or "" for r in states[4]}
    assert len(states[5]) == len(states[4])
    for r in states[5]:
        assert json.dumps(r.ids) == json.dumps([int(x) for x in own.encode(text[r.doc_id])[1].split()])
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, states[5]))


def without_lines(rows):
    """(id, text) after line dedup, by comparing every line with every other; documents that lose all they had are left out."""
    at = sorted((i, x, k, y.strip(" ")) for i, x in {r for r in rows if r[0] is not None and r[1]} for k, y in enumerate(x.split("\n")) if y.strip(" "))
    first = {}
    for i, x, k, y in sorted(at, key=lambda r: (r[0], r[2])):
        first.setdefault(y, (i, x, k))
    parts = {y: y.split(" ") for y in first}
    gone = {y for y in first if len(parts[y]) >= 8 and any(first[z] < first[y] and len(parts[z]) >= 8 and near(parts[y], parts[z]) for z in first if z != y)}
    out = []
    for i, x in rows:
        kept = x
        if i is not None and x:
            kept = "\n".join(y for k, y in enumerate(x.split("\n")) if not (z := y.strip(" ")) or (z not in gone and first[z] == (i, x, k)))
        if not (kept != x and not kept.strip()):
            out.append((i, kept))
    return out


def test_each_stage_by_brute_force(spark, folder):
    """Every stage's rows from its own input: verdicts, lines, groups, copies and tokens."""
    scratch, key = Scratch(spark, "test"), lambda r: (str(r[0]), str(r[1]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    said = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    verdicts = {r.doc_id: r.keep for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    one = scratch.table(corpus_pipeline.quality_classifier(spark, docs, folder))
    assert said(one) == [r for r in said(docs) if verdicts[r[0]]]
    two = scratch.table(corpus_pipeline.line_dedup(spark, one, folder))
    assert said(two) == sorted(without_lines(said(one)), key=key)
    assert all(r.n_chars == len(r.text or "") for r in two.collect())
    three = scratch.table(corpus_pipeline.ngram_jaccard_join(spark, two, folder))
    rows = said(two)
    assert said(three) == [r for r, (i, n, c) in zip(rows, grouped(rows), strict=True) if not n or i == c]
    four = scratch.table(corpus_pipeline.source_mixing(spark, three, folder))
    taken = {r.doc_id: r.copies if r.size else 1 for r in mixing.mix(three).collect()}
    assert said(four) == sorted((r for r in said(three) for _ in range(taken[r[0]])), key=key)
    own = bpe.load(bpe.vocabulary_path())
    want = sorted((r[0], [int(x) for x in own.encode(r[1] or "")[1].split()]) for r in said(four))
    assert sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.bpe_encoding(spark, four, folder).collect()) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, component_id string, keep string, size string, copies string, __h string"


@pytest.mark.parametrize("n", [0, 12])
def test_odd_tables(spark, folder, tmp_path, n):
    """An empty table, and one with nulls in every column, shared ids, repeated rows and columns with the operators' own names."""
    x = " ".join(f"w{i}" for i in range(40))
    data = [(None, None), (None, x), (1, x), (1, x), (1, "another text of one"), (2, x + " more"), (3, ""), (4, None), (5, " \n\t"), (6, "é " * 30), (7, x.replace(" ", "\n")), (8, "b")][:n]
    d = spark.createDataFrame([(i, t, None, None, None, *"rncksoh") for i, t in data], ODD)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "odd").table(stage(spark, docs, str(tmp_path)))
        assert docs.columns == d.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and (len(out) > 0) == (n > 0)
