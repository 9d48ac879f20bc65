"""Queries for the stored index, reports from the finest level up, refined communities, and what is selected for prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.catalog import table
from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.plans import reports as P
from loomgraph.queries import _BM25, TERMS_SQL, asked, query, term_graph
from loomgraph.sources.inverted import InvertedIndex
from loomgraph.sources.writers import Store

_BEST = f"WITH {_BM25} SELECT query_id, doc AS id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc::VARCHAR) AS r FROM bm) WHERE r <= 10"


def _terms(spark):
    return asked(spark).select("query_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))


def _index(spark) -> InvertedIndex:
    return InvertedIndex(Store(spark, f"{G.shared_folder(spark)}/index-{uuid.uuid4().hex}"), "documents")


def _found(index: InvertedIndex, spark):
    return index.search(_terms(spark), 10).select("query_id", F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"))


@query(_BEST)
def indexed_search(spark, d):
    """SCR-1: the best ten by BM25 from a stored index, which skips blocks and reads no text."""
    index = _index(spark)
    index.build(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return _found(index, spark)


@query(_BEST)
def indexed_updates(spark, d):
    """SCR-1: the same from an index that had documents with other texts, lost them, and got all others in further segments."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    index = _index(spark)
    first, rest = docs.where("lang = 'en'"), docs.where("lang <> 'en'")
    old = first.select("id", F.concat_ws(" ", "text", F.lit("the nation once had another text")).alias("text"))
    index.build(old)
    index.add(rest)
    index.remove(old)
    index.add(first)
    return _found(index, spark)


@query(f"""WITH {TERMS_SQL}, dg AS (SELECT src AS id, count(DISTINCT dst) AS degree FROM w GROUP BY 1),
 m AS (SELECT v.id, v.id[1] AS c, coalesce(degree, 0) AS d FROM v LEFT JOIN dg USING (id)),
 k AS (SELECT *, '- ' || id || ' (TERM): ' AS line, row_number() OVER (PARTITION BY c ORDER BY d DESC, id) AS r FROM m QUALIFY r <= 20),
 tk AS (SELECT *, greatest(len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')), length(line) // 4, 1) AS tokens FROM k),
 s AS (SELECT *, sum(tokens) OVER (PARTITION BY c ORDER BY r) AS running FROM tk),
 e AS (SELECT * FROM s WHERE running <= 120 OR r = 1),
 u AS (SELECT c, sum(tokens) AS used, count(*) AS named, string_agg(line, chr(10) ORDER BY r) AS entities FROM e GROUP BY 1),
 rl AS (SELECT a.c, a.d + b.d AS degrees, weight, src || '>' || dst AS id, '- ' || src || ' -> ' || dst || ' (RELATED): ' AS line FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst AND a.c = b.c),
 rt AS (SELECT *, greatest(len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')), length(line) // 4, 1) AS tokens, row_number() OVER (PARTITION BY c ORDER BY degrees DESC, weight DESC, id) AS r FROM rl),
 rs AS (SELECT *, used + sum(tokens) OVER (PARTITION BY rt.c ORDER BY r) <= 120 AS fits FROM rt JOIN u USING (c)),
 ra AS (SELECT c, string_agg(line, chr(10) ORDER BY r) FILTER (WHERE fits) AS relations, bool_or(NOT fits) AS cut FROM rs GROUP BY 1),
 n AS (SELECT c, least(count(*), 20) AS candidates FROM m GROUP BY 1),
 o AS (SELECT c, entities, coalesce(relations, '') AS relations, named < candidates OR coalesce(cut, false) AS truncated FROM n JOIN u USING (c) LEFT JOIN ra USING (c)),
 ch AS (SELECT id[1] AS c, id[1:2] AS k, count(*) AS size FROM v GROUP BY ALL),
 cl AS (SELECT c, k, size, '- ' || k || ' (rating ' || (size % 10) || '.5/10): Group of ' || size || ' names' AS line FROM ch JOIN o USING (c) WHERE truncated),
 ct AS (SELECT *, greatest(len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')), length(line) // 4, 1) AS tokens, row_number() OVER (PARTITION BY c ORDER BY size DESC, k) AS r FROM cl),
 cs AS (SELECT *, sum(tokens) OVER (PARTITION BY c ORDER BY r) AS running FROM ct),
 sb AS (SELECT c, string_agg(line, chr(10) ORDER BY r) AS sub_reports FROM cs WHERE running <= 120 OR r = 1 GROUP BY 1)
SELECT c AS community, entities, relations, coalesce(sub_reports, '') AS sub_reports, truncated FROM o LEFT JOIN sb USING (c)""")
def report_contexts(spark, d):
    """LLM-7, TOP-7: what reports are written from: members and relations within a budget, and, where these don't fit, the reports of
    sub-communities, the largest first. Communities are names of one first letter, their children those of two."""
    e, v = term_graph(spark, d)
    entities = v.select("id", F.col("id").alias("name"), F.lit("TERM").alias("type"), F.lit("").alias("description"))
    edges = e.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("RELATED").alias("type"), F.lit("").alias("description"), "weight")
    child = v.groupBy(F.substring("id", 1, 1).alias("community"), F.substring("id", 1, 2).alias("id")).agg(F.count("*").alias("size"))
    child = child.select("community", "id", F.col("id").alias("name"), F.concat(F.lit("Group of "), F.col("size").cast("string"), F.lit(" names")).alias("summary"), (F.col("size") % 10 + 0.5).alias("rating"), "size")
    return P.contexts(v.select("id", F.substring("id", 1, 1).alias("community")), edges, entities, child, 20, 120)


@query("SELECT 0::BIGINT AS apart")
def communities_apart(spark, d):
    """GRF-11: how many communities, of all levels, fall apart into several components: none, after the refinement."""
    e, v = term_graph(spark, d)
    return G.falling_apart(e, G.cut(G.communities(e, v))).agg(F.count("*").alias("apart"))


@query("""SELECT s_suppkey AS id FROM supplier ORDER BY coalesce(s_nationkey, 0) DESC, coalesce(s_acctbal, 0) DESC, s_suppkey LIMIT 10""")
def static_selection(spark, d):
    """TOP-2: reports by rank, then rating; suppliers stand for them."""
    s = table(spark, d, "supplier")
    return P.selected(s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("rank"), F.col("s_acctbal").alias("rating")), 10).select("id")


@query("""WITH p AS (SELECT p_brand AS b, p_name AS name, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS described, p_size AS units FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY described DESC, units DESC, name, id) AS r, count(*) OVER (PARTITION BY b) AS n FROM p)
SELECT b, string_agg(name, chr(10) ORDER BY r) || CASE WHEN any_value(n) > 5 THEN chr(10) || '... and ' || (any_value(n) - 5) || ' more entities' ELSE '' END AS listed FROM r WHERE r <= 5 GROUP BY b""")
def prompt_entities(spark, d):
    """TOP-3: names for a prompt: described ones first, then by text units, and how many more there are."""
    p = table(spark, d, "part")
    e = p.select(F.col("p_brand").alias("b"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, " ").otherwise("x").alias("description"), F.array_repeat(F.lit("u"), F.col("p_size").cast("int")).alias("text_unit_ids"))
    return P.listed_entities(e, ["b"], 5)


@query("""WITH r AS (SELECT l_suppkey AS s, l_orderkey::VARCHAR AS a, l_partkey::VARCHAR AS b, l_returnflag AS type, l_quantity AS w, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS described, l_orderkey || '-' || l_linenumber AS id FROM lineitem),
 o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY coalesce(w, 0) DESC, described DESC, id) AS r, count(*) OVER (PARTITION BY s) AS n FROM r)
SELECT s, string_agg('''' || a || ''' -> ''' || b || ''' (type: ''' || type || ''')', chr(10) ORDER BY r) || CASE WHEN any_value(n) > 3 THEN chr(10) || '... and ' || (any_value(n) - 3) || ' more relationships' ELSE '' END AS listed FROM o WHERE r <= 3 GROUP BY s""")
def prompt_relations(spark, d):
    """TOP-4: relations for a prompt: the heaviest first, then described ones, and how many more there are."""
    x = table(spark, d, "lineitem")
    r = x.select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.when(F.col("l_returnflag") == "N", "").otherwise("x").alias("description"), F.col("l_quantity").alias("weight"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    return P.listed_relations(r, ["s"], 3)
