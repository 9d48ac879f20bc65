"""Search strategies over the indexed tables (§2.15). A strategy takes the engine and queries(query_id, query) and returns
buckets, which are fused, made diverse and cut to the top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import words
from loomgraph.operators import retrieval as R
from loomgraph.operators.graph import cut, k_hop
from loomgraph.operators.relational import top_per, uncommon

STRATEGIES: dict[str, Callable] = {}


def strategy(name: str):
    """QRY-10, EXT-2: registers a strategy; a name can be taken once."""

    def add(f):
        if name in STRATEGIES:
            raise ValueError(f"{name} is registered")
        STRATEGIES[name] = f
        return f

    return add


#: Weights of words and of vectors in a search (SCR-3).
BOTH = (0.5, 0.5)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))


def _among(scored: DataFrame, only: DataFrame | None) -> DataFrame:
    """Of scored(query_id, id, score), what only(query_id, id) names for the same query."""
    return scored if only is None else scored.join(only.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")


def _results(best: DataFrame, table: DataFrame, bucket: str) -> DataFrame:
    """results(query_id, bucket, source, content, score, id) of best(query_id, id, score) over table(id, content)."""
    j = best.join(table, "id")
    return j.select("query_id", F.lit(bucket).alias("bucket"), F.concat(F.lit(bucket + ":"), F.col("id").cast("string")).alias("source"), "content", "score", F.col("id").cast("string").alias("id"))


#: What is searched: the column with the text of each kind.
TEXTS = {"text_units": "text", "entities": "name", "reports": "full_content", "claims": "description", "relation_names": "name"}


def _content(e, kind: str, best: DataFrame) -> DataFrame:
    """(id, content) of what is shown; from a stored table, only where these rows may lie."""
    text, store = TEXTS[kind], getattr(e, "store", None)
    if store is not None and store.exists(kind):
        return store.lookup(kind, best.select("id")).select("id", F.col(text).alias("content"))
    return getattr(e, kind).select("id", F.col(text).alias("content"))


def lexical(e, kind: str, queries: DataFrame, bucket: str, n: int = 20, only: DataFrame | None = None) -> DataFrame:
    """SCR-1 on one kind of rows. only: the rows that each query may find; weights of words are those of the whole table."""
    hit = cut(_said(e, kind, queries, n, only))
    return _results(hit, _content(e, kind, hit), bucket)


def _said(e, kind: str, queries: DataFrame, n: int, only: DataFrame | None) -> DataFrame:
    """(query_id, id, score): the best n by words; from the stored index where there is one, else from the texts."""
    index = e.index(kind) if hasattr(e, "index") else None
    if index is not None:
        return index.search(_asked(queries), n, only)
    hit = _among(_bm25(getattr(e, kind).select("id", F.col(TEXTS[kind]).alias("content")), queries), only)
    return top_per(hit, ["query_id"], [F.desc("score"), F.col("id")], n).select("query_id", "id", "score")


def _bm25(t: DataFrame, queries: DataFrame) -> DataFrame:
    asked = _asked(queries)
    return R.bm25(*R.counted(t, "id", "content", asked), asked).select("query_id", F.col("doc").alias("id"), "score")


def found(e, kind: str, queries: DataFrame, bucket: str, n: int = 20, only: DataFrame | None = None) -> DataFrame:
    """SCR-3 on one kind of rows: words and vectors, each scaled for each query, weighted and summed. Without vectors, words alone."""
    vectors = e.vectors(kind)
    if vectors is None:
        return lexical(e, kind, queries, bucket, n, only)
    asked = e.models.embed(queries.select("query_id", "query"), "query").select("query_id", F.col("embedding").alias("q"))
    if only is None:
        near = R.knn(vectors.select("id", F.col("embedding").alias("v")), asked, 4 * n)
    else:  # the rows of each query, whatever others ask for
        near = only.select("query_id", "id").distinct().join(vectors, "id").join(asked, "query_id").select("query_id", "id", R.cosine("embedding", "q").alias("score"))
        near = top_per(near.where("score is not null"), ["query_id"], [F.desc("score"), F.col("id")], 4 * n)
    near = near.where("score > 0").select("query_id", "id", "score")
    both = R.hybrid(_said(e, kind, queries, 4 * n, only), near, BOTH)
    best = cut(top_per(both, ["query_id"], [F.desc("score"), F.col("id")], n).select("query_id", "id", "score"))
    return _results(best, _content(e, kind, best), bucket)


def _claims(e, queries: DataFrame, n: int, only: DataFrame | None = None) -> list[DataFrame]:
    """FLT-10: the claims, where they are extracted; else nothing is searched."""
    return [lexical(e, "claims", queries, "claims", n, only)] if e.has_claims else []


@strategy("simple")
def simple(e, queries: DataFrame, n: int) -> list[DataFrame]:
    """QRY-1, SCR-4: all tables by words and vectors, the best of each together."""
    each = [
        found(e, "text_units", queries, "text", n), found(e, "entities", queries, "entity", n),
        found(e, "reports", queries, "community", n), *_claims(e, queries, n),
    ]
    return [R.merge_indices(each, n)]


@strategy("naive")
def naive(e, queries: DataFrame, n: int) -> list[DataFrame]:
    """QRY-6: text units alone."""
    return [lexical(e, "text_units", queries, "chunks", n)]


def _graph(e) -> DataFrame:
    return e.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")


def _expanded(e, seeds: DataFrame, bucket: str, hops: int = 2) -> DataFrame:
    """Graph neighbours of each query's own seeds(query_id, id), nearer ones first."""
    near = k_hop(_graph(e), seeds, hops, by=("query_id",))
    hit = near.join(e.entities.select("id", "name"), "id")
    return hit.select("query_id", F.lit(bucket).alias("bucket"), F.concat(F.lit("entity:"), F.col("id")).alias("source"), F.col("name").alias("content"), R.graph_relevance(F.lit(None).cast("double"), F.col("hop") + 1, F.lit(0.0), F.lit(0.0)).alias("score"), "id")


def _units_of(e, entities: DataFrame) -> DataFrame:
    """(query_id, id) of the text units of each query's entities(query_id, id), without common ones (FLT-8)."""
    rare = uncommon(e.entities.select("id", "text_unit_ids"))
    return entities.select("query_id", "id").distinct().join(rare, "id").select("query_id", F.explode("text_unit_ids").alias("id")).distinct()


@strategy("local")
def local(e, queries: DataFrame, n: int) -> list[DataFrame]:
    """QRY-2: entities of the query, their neighbours, the text units that these come from, reports, the relations and the claims
    that the entities have."""
    ents = cut(found(e, "entities", queries, "entities", n))
    around = cut(_expanded(e, ents, "graph_entities"))
    units = _units_of(e, ents.select("query_id", "id").union(around.select("query_id", "id")))
    touching = e.edges.select(F.col("id").alias("edge"), F.explode(F.array("source_id", "target_id")).alias("id")).join(ents.select("query_id", "id"), "id").select("query_id", F.col("edge").alias("id")).distinct()
    claims = []
    if e.has_claims:
        about = e.claims.select(F.col("id").alias("claim"), F.explode(F.array("subject_id", "object_id")).alias("id")).join(ents.select("query_id", "id"), "id").select("query_id", F.col("claim").alias("id")).distinct()
        claims = _claims(e, queries, n, about)
    return [
        ents, around, found(e, "text_units", queries, "text_units", n, units), found(e, "reports", queries, "community_reports", n),
        lexical(e, "relation_names", queries, "relationships", n, touching), *claims,
    ]


@strategy("global")
def global_(e, queries: DataFrame, n: int, threshold: float = 1.0, dynamic: bool = True) -> list[DataFrame]:
    """QRY-3: reports of the query (candidates); communities that the graph links them with, and their reports (JN-14); of both,
    those whose relevance reaches the threshold (LLM-10, FLT-9), or, when not dynamic, those of the highest rank, then rating
    (TOP-2); the text units of their communities; and, of three
    reports or more, the points that bear on the query."""
    candidates = found(e, "reports", queries, "reports", n)
    of = cut(e.reports.select("id", "level", "community_id", "rank", "rating"))
    members = e.members.withColumnRenamed("id", "entity")
    where = ["level", "community_id"]
    inside = candidates.select("query_id", "id").join(of, "id").join(members, where).select("query_id", F.col("entity").alias("id")).distinct()
    near = k_hop(_graph(e), inside, 1, by=("query_id",)).select("query_id", F.col("id").alias("entity"))
    further = near.join(members, "entity").join(of, where).select("query_id", "id").distinct()
    pool = cut(candidates.select("query_id", "id").union(further).distinct())
    if dynamic:
        shown = e.store.lookup("reports", pool.select("id")).select("id", "full_content")
        scored = pool.join(e.models.relevance(shown, queries), ["query_id", "id"], "left")
        kept = cut(R.relevant(scored.withColumn("score", F.coalesce("score", F.lit(0.0))), threshold))
    else:
        first = [F.desc(F.coalesce("rank", F.lit(0))), F.desc(F.coalesce("rating", F.lit(0.0))), F.col("id")]
        kept = cut(top_per(pool.join(of, "id"), ["query_id"], first, n).select("query_id", "id", (1.0 / F.col("rank")).alias("score")))
    best = cut(top_per(kept, ["query_id"], [F.desc("score"), F.col("id")], n).select("query_id", "id", "score"))
    rep = _results(best, _content(e, "reports", best), "reports")
    units = rep.select("query_id", "id").join(of, "id").join(members, where).select("query_id", F.col("entity").alias("id"))
    rare = units.distinct().join(e.entities.select("id", "text_unit_ids"), "id").select("query_id", F.explode("text_unit_ids").alias("id")).distinct()
    return [rep, found(e, "text_units", queries, "text_units", n, rare), _points(rep, queries, n)]


def _points(rep: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The map step: lines of the reports with words of the query, scored 0 to 100 by their share; the reduce step: the best of
    each query that has three reports or more."""
    enough = rep.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 3").select("query_id")
    line = rep.join(enough, "query_id", "left_semi").select("query_id", "id", F.posexplode(F.split("content", r"\n+")).alias("place", "line"))
    q = F.array_distinct(words(F.col("query")))
    score = F.floor(100.0 * F.size(F.array_intersect(q, words(F.col("line")))) / F.greatest(F.size(q), F.lit(1))).cast("double")
    got = line.join(queries, "query_id").withColumn("score", score).where("score > 0")
    best = top_per(got, ["query_id"], [F.desc("score"), F.col("id"), F.col("place")], n)
    return best.select("query_id", F.lit("points").alias("bucket"), F.concat_ws(":", F.lit("point"), "id", F.col("place").cast("string")).alias("source"), F.col("line").alias("content"), "score", F.col("id").cast("string").alias("id"))


@strategy("drift")
def drift(e, queries: DataFrame, n: int, rounds: int = 3, least_gain: int = 2) -> list[DataFrame]:
    """QRY-4, LLM-12: reports as a primer, then rounds of searching with a query that the last results' commonest words extend
    and with the text units of the entities near it, keeping what is new. A query ends when two rounds running gain fewer
    than least_gain (WIN-6)."""
    out = cut(found(e, "reports", queries, "results", 5))
    asked, before = queries, None
    for i in range(rounds):
        ents = found(e, "entities", asked, "results", 5)
        units = _units_of(e, ents.select("query_id", "id").union(k_hop(_graph(e), ents, 1, 10, by=("query_id",)).select("query_id", "id")))
        near = found(e, "text_units", asked, "results", n, units)
        got = lexical(e, "text_units", asked, "results", n).union(near).groupBy("query_id", "bucket", "source", "content", "id").agg(F.max("score").alias("score"))
        got = cut(got.select(out.columns).join(out.select("query_id", "source"), ["query_id", "source"], "left_anti"))
        out = cut(out.union(got.withColumn("score", F.col("score") / (i + 1))))
        gains = asked.select("query_id").join(got.groupBy("query_id").agg(F.count("*").alias("now")), "query_id", "left").select("query_id", F.coalesce("now", F.lit(0)).alias("now"))
        both = gains.withColumn("was", F.lit(least_gain)) if before is None else gains.join(before, "query_id")
        ended = both.where((F.col("now") < least_gain) & (F.col("was") < least_gain)).select("query_id")
        w = got.select("query_id", F.explode(F.array_distinct(F.filter(words(F.col("content")), lambda x: F.length(x) > 5))).alias("w")).groupBy("query_id", "w").agg(F.count("*").alias("c"))
        more = top_per(w, ["query_id"], [F.desc("c"), F.col("w")], 5).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("more"))
        before = cut(gains.withColumnRenamed("now", "was"))
        asked = cut(queries.join(ended, "query_id", "left_anti").join(asked.select("query_id"), "query_id", "left_semi").join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "more").alias("query")))
        if asked.isEmpty():
            break
    return [out]


def keyword_split(queries: DataFrame) -> DataFrame:
    """LLM-8, QRY-9, offline: long words ask for relations, the others for entities; a short query for entities as it is."""
    w = words(F.col("query"))
    low, high = F.filter(w, lambda x: F.length(x) <= 8), F.filter(w, lambda x: F.length(x) > 8)
    whole = (F.size(low) == 0) & (F.size(high) == 0) & (F.length("query") < 50)
    return queries.select("query_id", "query", F.when(whole, F.col("query")).otherwise(F.array_join(low, " ")).alias("low"), F.array_join(high, " ").alias("high"))


@strategy("hybrid")
def hybrid(e, queries: DataFrame, n: int) -> list[DataFrame]:
    """QRY-7: entities by the low keywords, relations by the high ones, and the graph around both (SET-6: entities first, then
    the ends of relations)."""
    k = keyword_split(queries)
    ents = cut(found(e, "entities", k.select("query_id", F.concat_ws(" ", "low", "high").alias("query")), "entities", n))
    rels = cut(lexical(e, "relation_names", k.select("query_id", F.concat_ws(" ", "high", "low").alias("query")), "relationships", n))
    ends = rels.select("query_id", "id").join(e.edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end")), "id").select("query_id", F.col("end").alias("id"))
    return [ents, rels, _expanded(e, ents.select("query_id", "id").union(ends), "graph_entities", 1)]


@strategy("mix")
def mix(e, queries: DataFrame, n: int) -> list[DataFrame]:
    """QRY-8: hybrid, the text units that each query's entities cite most (AGG-21), and text units by words."""
    parts = hybrid(e, queries, n)
    items = parts[0].select("query_id", "id").join(e.entities.select("id", F.posexplode("text_unit_ids").alias("place", "unit")), "id")
    cited = items.groupBy("query_id", "unit").agg(F.count("*").alias("citations"), F.min(F.struct("id", "place")).alias("first"))
    best = top_per(cited, ["query_id"], [F.desc("citations"), F.col("first"), F.col("unit")], n).select("query_id", F.col("unit").alias("id"), F.col("citations").cast("double").alias("score"))
    linked = _results(best, _content(e, "text_units", best), "linked_chunks")
    return [*parts, linked, *naive(e, queries, n)]


def route(query) -> F.Column:
    """QRY-5, LLM-9, offline: short questions are simple, broad ones global, comparisons drift, others local."""
    low = F.lower(query)
    return F.when(low.rlike(r"\b(overall|themes?|summar|main|overview)"), "global").when(low.rlike(r"\b(compare|relationship|why|how)\b"), "drift").when(F.size(words(query)) <= 3, "simple").otherwise("local")


def search(e, name: str, queries: DataFrame, k: int = 10, weights: dict[str, float] | None = None, fusion: str = "rrf", balance: float = 1.0, rerank: bool = False) -> DataFrame:
    """QRY-11, FUS-1..5: (query_id, rank, score, source, content) of a strategy, or of auto, which routes each query."""
    if name == "auto":
        routed = queries.withColumn("s", route(F.col("query")))
        parts = [search(e, r.s, routed.where(F.col("s") == r.s).drop("s"), k, weights, fusion, balance, rerank) for r in routed.select("s").distinct().collect()]  # 4 at most
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
    results = None
    for b in STRATEGIES[name](e, queries, 2 * k):
        b = b.select("query_id", "bucket", "source", "content", "score")
        results = b if results is None else results.unionByName(b)
    fused = R.rank_fusion(results, weights) if fusion == "rrf" else R.score_fusion(results, weights)
    if balance < 1:
        fused = R.diverse(top_per(fused, ["query_id"], [F.desc("score"), F.col("key")], 20 * k).drop("rank"), 2 * k, balance)
    if rerank:
        fused = R.rerank(fused.join(queries, "query_id"))
    return top_per(fused, ["query_id"], [F.desc("score"), F.col("key")], k).select("query_id", "rank", "score", "source", "content")
