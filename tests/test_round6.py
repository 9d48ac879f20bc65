"""Cases of round 3's findings F19 to F34 on time, disk and memory."""

import unicodedata

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.identity import entity_id, text_unit_id
from loomgraph.operators import evaluate as E
from loomgraph.operators import graph as G
from loomgraph.operators import relational as RL
from loomgraph.operators import retrieval as R
from loomgraph.operators import similarity as S
from loomgraph.plans import extract
from loomgraph.sources import readers
from loomgraph.sources.inverted import InvertedIndex
from loomgraph.sources.writers import Store

UNITS = [(1, 0, "Straße strasse castles ÉCOLES guarded écoles"), (1, 1, "castles abc_defghi x1castles ǅabcdefgh tower"), (None, 0, "tower castles guarded"), (None, 0, "Guarded"), (2, 0, ""), (2, 1, None), (3, 0, "ﬁnding towers ſſſſſſ ΑΣΣΣΣΣ guarded")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def _merged(units, least):
    """The entities and relations by rows for each occurrence, as they were merged before."""
    w = F.array_distinct(F.filter(T.words(F.coalesce("text", F.lit(""))), lambda x: (F.length(x) >= least) & x.rlike(r"^\p{L}+$")))
    t = units.select(extract.text_unit_key("document_id", "number").alias("unit"), F.struct("document_id", "number").alias("ord"), w.alias("w"))
    name = T.normalize_name("term")
    each = t.select("unit", "ord", F.explode("w").alias("term"))
    return RL.merge_extracted_entities(each.select(entity_id(name).alias("id"), name.alias("name"), F.lit("TERM").alias("type"), F.lit("").alias("description"), F.array("unit").alias("text_unit_ids"), F.lit(1.0).alias("confidence"), "ord"))


def test_entities_are_counted_without_a_row_of_text_for_each(spark):
    """the entities as before; what is shuffled for an occurrence is a name and 16 bytes, and no text is joined."""
    units = spark.createDataFrame(UNITS, "document_id int, number int, text string")
    ents, edges = extract.extract_graph(units)
    assert _rows(ents) == _rows(_merged(units, 6)) and ents.count() >= 8
    assert {r.name: r.units for r in extract.frequencies(units).collect()}["guarded"] == 4
    more = extract.glean(units, ents, edges, rounds=1)[0]
    low = {(d, n): (t or "").lower() for d, n, t in UNITS}
    ids = {r.id: (r.document_id, r.number) for r in units.select(text_unit_id(F.col("document_id").cast("string"), F.col("number")).alias("id"), "document_id", "number").collect()}
    want = [r for r in _merged(units, 5).collect() if any(r.name in low[ids[u]] or (ids[u][0] is None and r.name in "tower castles guarded") for u in r.text_unit_ids)]
    assert _rows(more) == sorted(map(str, want)) and "tower" in {r.name for r in more.collect()}
    assert "Join" not in _plan(more) and _plan(more).count("Aggregate") == 1


def test_relations_are_merged_by_names(spark):
    """relations of words a few places apart, once for each unit, with all their units."""
    units = spark.createDataFrame([(1, 0, "castles guarded armies castles"), (1, 1, "Armies GUARDED rivers")], "document_id int, number int, text string")
    ents, edges = extract.extract_graph(units)
    name = {r.id: r.name for r in ents.collect()}
    assert {(name[r.source_id], name[r.target_id]): (r.weight, len(r.text_unit_ids)) for r in edges.collect()} == {
        ("castles", "guarded"): (1.0, 1), ("armies", "castles"): (1.0, 1), ("armies", "guarded"): (2.0, 2), ("guarded", "rivers"): (1.0, 1), ("armies", "rivers"): (1.0, 1)}


def test_letter_words_are_those_of_words(spark):
    texts = ["a1b abcdefghijkl, abcdefghijklm_ ÀÉÎÕÜàéîõüßß x́abcdefghijklmn abcdefghijklmń 𝒜𝒷𝒸𝒹𝑒𝒻𝑔𝒽𝒾𝒿𝓀𝓁", "", None, "IİIIIIIIIIIIIIII ΑΣΣΣΣΣΣΣΣΣΣΣΣΣ."]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(T.words(F.col("t")), lambda x: (F.length(x) >= 12) & x.rlike(r"^\p{L}+$"))
    assert all(r.a == r.b for r in d.select(T.letter_words("t", 12).alias("a"), old.alias("b")).collect())
    each = F.filter(T.words(F.col("t")), lambda x: x.rlike(r"^\p{L}+$"))
    got = d.where("t is not null").select(each.alias("w"), T.normalize_names(each).alias("n")).collect()
    assert [r.n for r in got] == [[T._name(x) for x in r.w] for r in got] and unicodedata.normalize("NFKC", "𝒜") == "A"


def test_ranks_need_no_job_for_a_round(spark):
    """the rank of vertices without edges follows from the last one; edges that lead out of the vertices take their share along."""
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 3.0), ("c", "x", 4.0), ("y", "d", 1.0)]  # x and y are no vertices
    ids = ["a", "b", "c", "d", "e", "f"]
    e, v = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(i,) for i in ids], "id string")
    both = edges + [(d, s, w) for s, d, w in edges]
    total = {i: sum(w for s, _, w in both if s == i) for i in ids}
    rank = dict.fromkeys(ids, 1 / 6)
    for _ in range(6):
        lost = sum(rank[i] for i in ids if not total[i])
        rank = {i: 0.85 * (sum(rank[s] * w / total[s] for s, d, w in both if d == i and s in rank) + lost / 6) + 0.15 / 6 for i in ids}
    jobs = []
    for rounds, tolerance in ((6, None), (1, None), (6, 0.0)):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}-{tolerance}", "")
        out = G.pagerank(e, v, rounds=rounds, tolerance=tolerance)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}-{tolerance}")))
        if rounds == 6:
            got = {r.id: r["rank"] for r in out.collect()}
            assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-12 for i in ids)
    assert jobs[0] == jobs[1]


def test_an_index_shuffles_documents_rather_than_their_words(spark, tmp_path):
    """terms are counted where a document is; blocks are formed behind the one shuffle by shard. Odd documents count as
    before: without words, without an id, and twice the same."""
    docs = [(1, "the cat and the dog"), (2, None), (3, "..."), (None, "cat"), (4, "cat cat cat"), (4, "cat cat cat"), (5, "Dog " * 40), (6, "ünïcode cat")]
    d = spark.createDataFrame(docs, "id int, text string")
    got = InvertedIndex._parted(d, "text")
    assert "Aggregate" not in _plan(got) and {r.id: (r.len, dict(zip(r.terms, r.tfs))) for r in got.collect()} == {
        "1": (5, {"and": 1, "cat": 1, "dog": 1, "the": 2}), "2": (0, {}), "3": (0, {}), "4": (3, {"cat": 3}), "5": (40, {"dog": 40}), "6": (2, {"cat": 1, "ünïcode": 1})}
    ix = InvertedIndex(Store(spark, str(tmp_path)), "docs", shard=2)
    written = []
    ix.store.replace, replace = lambda name, df, *a, **k: (written.append((name, df._jdf.queryExecution().executedPlan().toString())), replace(name, df, *a, **k))[1], ix.store.replace
    ix.build(d)
    blocks = dict(written)["docs.s1"]
    assert blocks.count("- Exchange ") == 1
    assert [tuple(r)[1:] for r in ix.segments()] == [(7, 53)]
    asked = spark.createDataFrame([("q", "cat"), ("q", "dog")], "query_id string, term string")
    p = R.postings(d.where("id is not null").select("id", F.coalesce("text", F.lit("")).alias("text")), "id", "text")
    lens = d.where("id is not null").select(F.col("id").alias("doc"), F.size(T.words(F.coalesce("text", F.lit("")))).alias("len"))
    want = {str(r.doc): round(r.score, 9) for r in R.bm25(p, lens, asked).collect()}
    assert {r.id: round(r.score, 9) for r in ix.search(asked, 10).collect()} == want
    odd = spark.createDataFrame([("a b\n%20+", "cat zebra"), ("", "zebra")], "id string, text string")
    ix.add(odd)
    assert {r.id for r in ix.search(spark.createDataFrame([("q", "zebra")], "query_id string, term string"), 10).collect()} == {"a b\n%20+", ""}
    ix.remove(odd)
    ix.remove(d.where("id = 1"))
    ix.merge()
    assert {r.id for r in ix.search(asked, 10).collect()} == {"4", "5", "6"}


def test_only_utf_16_leaves_the_jvm(spark):
    """F32: files are decoded as before; Python gets none that are UTF-8 or Latin-1, however large."""

    def one(b):
        if b is None:
            return None
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return b.decode("utf-16", "replace")
        try:
            return b.decode("utf-8-sig")
        except UnicodeDecodeError:
            return b.decode("latin-1")

    given = [None, b"", b"plain", "ünï\U0001d49c\n".encode(), b"\xef\xbb\xbfmarked", b"\xef\xbb\xbf", b"\xef\xbb\xbf\xef\xbb\xbftwice", "sixteen ü".encode("utf-16"), b"\xfe\xff\x00a\x00", b"\xff\xfe", b"latin \xe9\xff\x80", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xef\xbb\xbf\xe9", b"a\x00b"]
    d = spark.createDataFrame([(i, b) for i, b in enumerate(given)], "i int, content binary")
    sent = readers._marked
    got = {r.i: r.text for r in readers.READERS["txt"](d).select("i", "text").collect()}
    assert got == {i: one(b) for i, b in enumerate(given)}
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(s):
        seen.add(int(s.notna().sum()))
        return s.map(lambda b: None if b is None else b.decode("utf-16", "replace"))

    try:
        readers._marked = counted
        readers.READERS["txt"](d).select("text").collect()
    finally:
        readers._marked = sent
    assert seen.value == 3


def test_phrases_are_found_where_a_text_is_parted(spark, monkeypatch):
    """tokens by patterns over whole texts; no document is shuffled while phrases are few; rows that are equal count each."""
    texts = ["The (quick) brown-fox, jumps.", "...quick brown-fox jumps!", "--- quick --- brown-fox", None, "", "a 'b' c.d .e. ??", "The (quick) brown-fox, jumps."]
    docs = spark.createDataFrame([(i if i < 6 else 0, t) for i, t in enumerate(texts)] + [(None, "quick brown-fox")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "quick, brown-fox"), (2, "b c.d e"), (3, "..."), (4, None), (5, "fox"), (6, "jumps")], "item_id int, text string")
    old = docs.where("text is not null").select(F.concat(F.lit(" "), F.array_join(T.coverage_tokens(F.col("text")), " "), F.lit(" ")).alias("a"), E._spaced(F.col("text")).alias("b"))
    assert all(r.a.strip() == r.b.strip() for r in old.collect())
    want = sorted([(1, 0), (1, 0), (1, 1), (1, 2), (1, -1), (2, 5), (6, 0), (6, 0), (6, 1)])
    found = lambda: E.phrase_hits(items, docs)
    assert "- Exchange hash" not in found()._jdf.queryExecution().executedPlan().toString()
    got = [sorted((r.item_id, -1 if r.doc_id is None else r.doc_id) for r in found().collect())]
    monkeypatch.setattr(E, "SENT", 0)
    got.append(sorted((r.item_id, -1 if r.doc_id is None else r.doc_id) for r in found().collect()))
    assert got == [want, want]


def test_only_sets_in_pairs_are_sent(spark, monkeypatch):
    """shingles are made again only of documents that have a candidate."""
    base = [f"w{i} x{i} y{i} z{i} " * 3 + " ".join(f"{i}-{k}" for k in range(30)) for i in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base + [base[2], base[5] + " more"])], "doc_id int, text string")
    kept = []
    monkeypatch.setattr(S, "cut", lambda df: (kept.append(G.cut(df)), kept[-1])[1])
    assert {(r.a, r.b) for r in S.similar_documents(docs, "doc_id", "text", 0.8).collect()} == {(2, 8), (5, 9)}
    sets = [k for k in kept if k.columns == ["id", "s"]]
    assert sets and all({r.id for r in k.collect()} <= {2, 5, 8, 9} for k in sets)
