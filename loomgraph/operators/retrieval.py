"""Lexical, vector and graph retrieval, fusion and context (§2.6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.identity import result_key
from loomgraph.functions.text import words
from loomgraph.operators.graph import cut

K1, B = 1.2, 0.75
#: Weights of section types in a context.
SECTION_WEIGHT = {"TEXT": 1.3, "ENTITY": 1.2, "RELATIONSHIP": 1.1, "CLAIM": 1.1, "COMMUNITY": 1.0, "GENERAL": 0.8}
RESERVED = 512


#: Queries that are sent to all tasks at once, and edits that fuzzy terms may need at most.
QUERIES_SENT, EDITS = 2000, 2
#: Terms of queries that are sent to all tasks.
TERMS_SENT = 100_000
#: Rows that a task compares with all queries that were sent, at once.
ROWS_AT_ONCE = 512


def postings(docs: DataFrame, id: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf, len): the inverted index, one shuffle by (term, doc) with partial counts. With terms(term), only theirs:
    other words go before the shuffle."""
    w = docs.select(F.col(id).alias("doc"), words(F.col(text)).alias("w"))
    # explode_outer: for explode, the optimizer would infer a filter that parts the text a second time.
    each = w.select("doc", F.size("w").alias("len"), F.explode_outer("w").alias("term")).where("term is not null")
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))


def counted(docs: DataFrame, id: str, text: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings() of terms(term), and (doc, len) of all documents, for which each text is parted once. Other words go where the text
    is parted, unless the terms are too many to be sent."""
    asked = cut(terms.select("term").where("term is not null").distinct())
    w = docs.select(F.col(id).alias("doc"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    # Each document has a row without a term besides those of its words.
    each = w.select("doc", F.size("w").alias("len"), F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("term"))
    own = asked.union(asked.sparkSession.sql("SELECT CAST(NULL AS STRING) AS term")).withColumnRenamed("term", "own")
    own = F.broadcast(own) if asked.count() <= TERMS_SENT else own
    each = cut(each.join(own, F.col("term").eqNullSafe(F.col("own")), "left_semi").groupBy("term", "doc", "len").agg(F.count("*").alias("tf")))
    alone = each.where("term is null").select("doc", "len", F.explode(F.sequence(F.lit(1).cast("long"), "tf"))).select("doc", "len")
    return each.where("term is not null"), alone


def bm25(index: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """SCR-1: (query_id, doc, score) for terms(query_id, term). docs(doc, len): all documents, for their number and mean length."""
    n = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avglen"))
    hit = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    j = hit.join(df, "term").join(terms.distinct(), "term").crossJoin(F.broadcast(n))  # n is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    return j.groupBy("query_id", "doc").agg(F.sum(part).alias("score"))


def _deletions(c: str, most: Column) -> Column:
    """The distinct texts that up to `most` (0 to EDITS) deletions of a character leave, the text itself among them."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
    safe = lambda x: F.when(F.length(x) > 0, once(x)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    one = F.when(most >= 1, safe(F.col(c))).otherwise(none)
    two = F.when(most >= 2, F.flatten(F.transform(safe(F.col(c)), safe))).otherwise(none)
    return F.array_distinct(F.concat(F.array(c), one, two))


def fuzzy_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """SCR-1, fuzziness: terms within 0, 1 or 2 edits by the length of the query's (under 3, under 6, more). Texts within k edits
    share one that k deletions of each leave, so both sides emit these and equal ones meet in a join; none is lost. Of the
    vocabulary, only terms of a length near a query's emit any, and the query's own terms always match."""
    most = lambda n: F.when(n < 3, 0).when(n < 6, 1).otherwise(EDITS)
    q = terms.select("query_id", F.col("term").alias("q"), most(F.length("term")).alias("most")).distinct()
    # A length in reach of several queries' needs as many deletions as the most tolerant of them allows.
    lengths = q.select(F.explode(F.sequence(F.greatest(F.length("q") - F.col("most"), F.lit(0)), F.length("q") + F.col("most"))).alias("n"), "most").groupBy("n").agg(F.max("most").alias("most"))
    v = vocabulary.select("term").distinct().withColumn("n", F.length("term")).join(F.broadcast(lengths), "n")  # a row for each length
    left = v.select("term", F.explode(_deletions("term", F.col("most"))).alias("d"))
    right = q.select("query_id", "q", "most", F.explode(_deletions("q", F.col("most"))).alias("d"))
    near = left.join(right, "d").where(F.levenshtein("term", "q") <= F.col("most"))
    return near.select("query_id", "term").union(terms.select("query_id", "term")).distinct()


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """SCR-2: (query_id, id, score, rank): the k nearest of vectors(id, v) by cosine for queries(query_id, q), after a filter.
    QUERIES_SENT queries at a time go to all tasks, which keep the k best of their rows, ROWS_AT_ONCE compared at once; ties go to the smaller id.
    Null and zero vectors, and those of another length than the query's, are near nothing."""
    v = (vectors if where is None else vectors.where(where)).select("id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q is not null")
    kinds = v.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    schema, out = f"query_id {kinds[1]}, id {kinds[0]}, score double", None
    blocks = -(-asked.count() // QUERIES_SENT)
    for b in range(max(1, blocks)):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == b).toPandas()  # about QUERIES_SENT rows
        by_length = {n: (g["query_id"].to_numpy(), np.stack(g["q"].to_list())) for n, g in part.groupby(part["q"].map(len)) if n}

        def best(batches, by_length=by_length):
            held = {}  # of each length, the k best of the task's rows so far: scores and ids, a column for each query
            for df in batches:
                size = df["v"].map(len)
                for n, (_, q) in by_length.items():
                    own = df[size == n]
                    for a in range(0, len(own), ROWS_AT_ONCE):
                        part = own.iloc[a : a + ROWS_AT_ONCE]
                        x = np.stack(part["v"].to_list())
                        norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
                        score = np.round(np.divide(x @ q.T, norm, out=np.full(norm.shape, -np.inf), where=norm > 0), 12)
                        ids = np.broadcast_to(part["id"].to_numpy()[:, None], score.shape)
                        if n in held:
                            score, ids = np.vstack([held[n][0], score]), np.vstack([held[n][1], ids])
                        order = np.lexsort((ids, -score), axis=0)[:k]
                        held[n] = np.take_along_axis(score, order, 0), np.take_along_axis(ids, order, 0)
            for n, (score, ids) in held.items():
                at, who = np.nonzero(np.isfinite(score))
                yield pd.DataFrame({"query_id": by_length[n][0][who], "id": ids[at, who], "score": score[at, who]})

        got = v.mapInPandas(best, schema)
        out = got if out is None else out.union(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def min_max(df: DataFrame, group: list[str], c: str = "score") -> DataFrame:
    """FUS-2, WIN-2: scores of each group scaled to 0..1; equal or missing ones are 0.5."""
    w = Window.partitionBy(*group)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return df.withColumn(c, F.when(F.col(c).isNull() | (hi == lo), 0.5).otherwise((F.col(c) - lo) / (hi - lo)))


def hybrid(lexical: DataFrame, vector: DataFrame, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """SCR-3: weighted mean of the two scaled scores (query_id, id, score); a missing one is 0."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    a = min_max(lexical, ["query_id"]).select("query_id", "id", (F.col("score") * weights[0]).alias("score"))
    b = min_max(vector, ["query_id"]).select("query_id", "id", (F.col("score") * weights[1]).alias("score"))
    return a.union(b).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def rank_fusion(results: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """FUS-1: results(query_id, bucket, source, content, score), ranked in each bucket, summed over buckets as w/(k+rank)."""
    w = Window.partitionBy("query_id", "bucket").orderBy(F.desc_nulls_last("score"), "source", "content")
    r = results.withColumn("rank", F.row_number().over(w)).withColumn("key", result_key(F.col("source"), F.col("content")))
    by = F.lit(1.0)
    for b, x in (weights or {}).items():
        by = F.when(F.col("bucket") == b, x).otherwise(by)
    first = F.struct("bucket", "rank")
    return r.groupBy("query_id", "key").agg(F.sum(by / (k + F.col("rank"))).alias("score"), F.min_by("source", first).alias("source"), F.min_by("content", first).alias("content"))


def score_fusion(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """FUS-2: scaled scores of each bucket, weighted and summed."""
    by = F.lit(1.0)
    for b, x in (weights or {}).items():
        by = F.when(F.col("bucket") == b, x).otherwise(by)
    r = min_max(results, ["query_id", "bucket"]).withColumn("key", result_key(F.col("source"), F.col("content")))
    return r.groupBy("query_id", "key").agg(F.sum(by * F.col("score")).alias("score"), F.min_by("source", "bucket").alias("source"), F.min_by("content", "bucket").alias("content"))


def diverse(results: DataFrame, n: int, balance: float = 0.5) -> DataFrame:
    """FUS-3: for each query, the best result, then again and again the one with most balance * score - (1 - balance) *
    likeness to those taken (Jaccard of words), up to n. A few hundred candidates a query are bounded by retrieval."""
    if balance >= 1:
        return results

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "key"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(str(x).lower().split()) for x in df["content"]]
        like, taken = [0.0] * len(df), []
        while len(taken) < min(n, len(df)):
            best = max((i for i in range(len(df)) if i not in taken), key=lambda i: (df["score"][i] if not taken else balance * df["score"][i] - (1 - balance) * like[i], -i))
            taken.append(best)
            for i in range(len(df)):
                union = len(sets[i] | sets[best])
                like[i] = max(like[i], len(sets[i] & sets[best]) / union if union else 0.0)
        return df.iloc[taken]

    return results.groupBy("query_id").applyInPandas(pick, results.schema)


def rerank(results: DataFrame, query: str = "query", k: int | None = None) -> DataFrame:
    """FUS-4, RRK-1, offline: the score becomes the share of the query's words that the content has."""
    q = F.array_distinct(words(F.col(query)))
    s = F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(F.col("content")))) / F.size(q))
    return results.withColumn("score", s)


def graph_relevance(importance, path_length, text, kind) -> Column:
    """SCR-5."""
    return F.least(F.lit(1.0), 0.4 * F.coalesce(importance, F.lit(0.5)) + 0.3 / F.greatest(path_length, F.lit(1)) + 0.2 * text + 0.1 * kind)


def seeds(entities: DataFrame, least: float = 0.5, n: int = 10) -> DataFrame:
    """SCR-6: entities of importance, the most important first."""
    return entities.where(F.col("importance") >= least).orderBy(F.desc("importance"), "id").limit(n)


def section_priority(score, kind) -> Column:
    """CTX-1: the score (missing or 0: a half) times the type's weight."""
    by = F.lit(SECTION_WEIGHT["GENERAL"])
    for k, v in SECTION_WEIGHT.items():
        by = F.when(kind == k, v).otherwise(by)
    return F.when(score.isNull() | (score == 0), 0.5).otherwise(score) * by


def pack(sections: DataFrame, budget: int) -> DataFrame:
    """CTX-1: for each query, sections by falling priority, each taken if it still fits. sections: query_id, key, tokens, priority."""

    def fill(df: pd.DataFrame) -> pd.DataFrame:
        left, take = budget - RESERVED, []
        df = df.sort_values(["priority", "key"], ascending=[False, True])
        for i, n in zip(df.index, df["tokens"], strict=True):
            if 0 < n <= left:
                left -= n
                take.append(i)
        return df.loc[take]

    return sections.groupBy("query_id").applyInPandas(fill, sections.schema)


def leading(items: DataFrame, budget: int, group: tuple[str, ...] = ("query_id",), order: str = "rank") -> DataFrame:
    """CTX-6: items(content, tokens) of each group in order while they fit; the first that doesn't is cut to what is left,
    with ... behind it, and the rest goes."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = items.withColumn("__before", F.sum("tokens").over(w) - F.col("tokens")).where(F.col("__before") < budget)
    left = F.lit(budget) - F.col("__before")
    part = F.concat(F.left("content", F.floor(F.length("content") * left / F.col("tokens")).cast("int")), F.lit("..."))
    return d.withColumn("content", F.when(F.col("tokens") > left, part).otherwise(F.col("content"))).drop("__before")


def merge_indices(results: list[DataFrame], k: int, multiplier: int = 2) -> DataFrame:
    """SCR-4: the results of several indices together, by their raw scores, k * multiplier of each query."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "content")
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k * multiplier).drop("__r")


def relevant(scored: DataFrame, threshold: float) -> DataFrame:
    """FLT-9: rows whose score reaches the threshold; one that could not be scored counts as reaching it."""
    return scored.where(F.coalesce("score", F.lit(threshold)) >= threshold)


def section_type(index: Column) -> Column:
    """PRJ-3: the kind of section that an index's name stands for."""
    out = F.lit("GENERAL")
    for prefix, kind in (("communit", "COMMUNITY"), ("report", "COMMUNITY"), ("claim", "CLAIM"), ("relationship", "RELATIONSHIP"), ("entit", "ENTITY"), ("text", "TEXT"), ("chunk", "TEXT")):
        out = F.when(F.startswith(F.lower(index), F.lit(prefix)), kind).otherwise(out)
    return out


def context_quality(chosen: DataFrame, offered: DataFrame) -> DataFrame:
    """CTX-2: 0.7 of the priority covered and 0.3 of the types covered, at most 1."""
    c = chosen.groupBy("query_id").agg(F.sum("priority").alias("p"), F.countDistinct("type").alias("t"))
    o = offered.groupBy("query_id").agg(F.sum("priority").alias("all_p"), F.countDistinct("type").alias("all_t"))
    q = F.least(F.lit(1.0), 0.7 * F.coalesce(F.col("p") / F.col("all_p"), F.lit(0.0)) + 0.3 * F.coalesce(F.col("t") / F.col("all_t"), F.lit(0.0)))
    return o.join(c, "query_id", "left").select("query_id", q.alias("quality"))


def context_text(chosen: DataFrame) -> DataFrame:
    """CTX-3: the sections of each query under their headings, in order of priority."""
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "key", "type", "content"))), lambda x: F.concat(F.lit("## "), x["type"], F.lit("\n"), x["content"]))
    return chosen.groupBy("query_id").agg(F.array_join(each, "\n\n").alias("context"))
