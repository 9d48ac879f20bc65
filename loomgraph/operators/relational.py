"""Filters, joins, aggregates, sets and windows over the graph's tables (§2.3 to §2.9).

Tables: entities(id, name, type, description, text_unit_ids, confidence, ...), relationships(id, source_id, target_id,
type, weight, text_unit_ids, ...), claims(subject_id, object_id, ...), text_units(id, document_id, text). Every "first"
goes by an explicit ordinal, every order ends with a unique key, and lineage is joined in long form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters and projections ------------------------------------------------------------------------------------------


def filter_map(filters: dict) -> Column:
    """FLT-1, FLT-2: a list means one of, a dict means a range or comparison, anything else equality; all hold."""
    ops = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__, "eq": Column.__eq__, "neq": Column.__ne__}

    def one(key, value) -> Column:
        c = F.col(key)
        if isinstance(value, dict):
            return reduce(Column.__and__, [ops[o](c, F.lit(v)) for o, v in value.items()])
        return c.isin(*value) if isinstance(value, (list, tuple, set)) else c == value

    return reduce(Column.__and__, [one(k, v) for k, v in filters.items() if k != "id"], F.lit(True))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """FLT-3, FLT-4, JN-15, JN-19: rows whose key is among ids(id); a semi-join, however long the list."""
    return df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def confident(df: DataFrame, least: float) -> DataFrame:
    """FLT-5."""
    return df if least <= 0 else df.where(F.coalesce("confidence", F.lit(1.0)) >= least)


def without_orphans(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """FLT-6, JN-1: edges whose ends are both entities."""
    ids = entities.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(edges.columns)


def grounding_gate(df: DataFrame, grounded: Column, column: str = "confidence", penalty: float | None = None) -> DataFrame:
    """FLT-7: what is not grounded goes, or has its confidence (an edge: its weight) reduced."""
    if penalty is None:
        return df.where(grounded)
    return df.withColumn(column, F.when(grounded, F.col(column)).otherwise(F.coalesce(F.col(column), F.lit(1.0)) * penalty))


def grounded_pairs(spans: DataFrame, chunks: DataFrame, least: float = 0.6) -> DataFrame:
    """STR-5 of all spans(span, ...) against all chunks(chunk, ...) by a join on words: the columns of both for the pairs of which
    the chunk holds the share `least` of the span's words, or the span itself. Spans of fewer than 4 words, which are grounded
    in everything, are left out. Texts are normalised ones. A span that a chunk holds has all its words there but the first and
    the last, which may be parts of others, so only pairs with so many are looked at."""
    tokens = F.filter(F.split("span", " "), lambda x: x != "")
    s = spans.withColumn("__k", F.size(tokens)).where(F.col("__k") >= 4).withColumn("__s", F.xxhash64(*spans.columns))
    c = chunks.where(F.coalesce("chunk", F.lit("")) != "").withColumn("__c", F.xxhash64(*chunks.columns))
    a = s.select("__s", "__k", F.explode(F.filter(F.split("span", " "), lambda x: x != "")).alias("t")).groupBy("__s", "__k", "t").agg(F.count("*").alias("m"))
    b = c.select("__c", F.explode(F.array_distinct(F.split("chunk", " "))).alias("t"))
    met = a.join(b, "t").groupBy("__s", "__k", "__c").agg(F.sum("m").alias("m")).where(F.col("m") >= F.least(F.col("__k") - 2, F.col("__k") * least))
    j = met.join(s.drop("__k"), "__s").join(c, "__c")
    return j.where((F.col("m") / F.col("__k") >= least) | F.contains("chunk", "span")).drop("__s", "__c", "__k", "m")


def uncommon(entities: DataFrame, most: int = 20) -> DataFrame:
    """FLT-8: entities of at most so many text units."""
    return entities.where(F.coalesce(F.size("text_unit_ids"), F.lit(0)) <= most)


def name_predicate(query: str, focus: list[str] | None = None) -> Column:
    """FLT-14: the names in focus, else names that contain a word of the query."""
    import re

    if focus:
        return F.col("name").isin(*focus)
    terms = re.findall(r"\b\w+\b", query.lower())
    return reduce(Column.__or__, [F.contains("name", F.lit(t)) for t in terms], F.lit(False))


def content(*parts: Column) -> Column:
    """PRJ-1: the parts that are there, each once, in order, with blank lines between."""
    given = F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_join(F.array_distinct(given), "\n\n")


def report_body(name, rating, why, summary, findings) -> Column:
    """PRJ-4: heading, rating, summary, and a section for each finding(summary, explanation)."""
    each = F.transform(findings, lambda x: F.concat(F.lit("## "), x["summary"], F.lit("\n"), x["explanation"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), name), F.concat(F.lit("Rating: "), rating.cast("string"), F.lit(" - "), why), summary, F.array_join(each, "\n\n"))


# --- joins ------------------------------------------------------------------------------------------------------------


def claim_links(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """JN-2: which ends of each claim are entities: both, one or none."""
    ids = entities.select("id").distinct()
    j = claims.join(ids.select(F.col("id").alias("subject_id"), F.lit(1).alias("s")), "subject_id", "left").join(ids.select(F.col("id").alias("object_id"), F.lit(1).alias("o")), "object_id", "left")
    n = F.coalesce("s", F.lit(0)) + F.coalesce("o", F.lit(0))
    return j.withColumn("connection", F.element_at(F.array(F.lit("none"), F.lit("one"), F.lit("both")), n + 1)).drop("s", "o")


def stub_entities(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """JN-3: entities for ends of edges that have none; the first edge (by ord) lends its text units."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")), F.struct(F.col("target_id").alias("id"), F.col("target_name").alias("name")))).alias("e"), "ord", "text_unit_ids")
    ends = ends.select("e.id", "e.name", "ord", "text_unit_ids").join(entities.select("id"), "id", "left_anti")
    return ends.groupBy("id").agg(F.min_by("name", "ord").alias("name"), F.min_by("text_unit_ids", "ord").alias("text_unit_ids"))


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN-4: ends replaced by mapping(old, new); self-loops go."""
    m = lambda end: mapping.select(F.col("old").alias(end), F.col("new").alias(f"__{end}"))
    j = edges.join(m("source_id"), "source_id", "left").join(m("target_id"), "target_id", "left")
    j = j.withColumn("source_id", F.coalesce("__source_id", "source_id")).withColumn("target_id", F.coalesce("__target_id", "target_id"))
    return j.where("source_id <> target_id").select(edges.columns)


def lineage(artifacts: DataFrame, units: DataFrame) -> DataFrame:
    """JN-5, FLT-12: (document_id, id) of every document that an artifact's text units come from."""
    return artifacts.select("id", F.explode("text_unit_ids").alias("unit")).join(units.select(F.col("id").alias("unit"), "document_id"), "unit").select("document_id", "id").distinct()


def enrich_units(units: DataFrame, communities: DataFrame) -> DataFrame:
    """JN-6: the ids of the communities of each text unit, sorted."""
    of = communities.select(F.col("id").alias("c"), F.explode("text_unit_ids").alias("id")).groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("community_ids"))
    return units.drop("community_ids").join(of, "id", "left").withColumn("community_ids", F.coalesce("community_ids", F.array().cast("array<string>")))


def units_of_communities(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """JN-17, JN-16: text units of the communities in wanted(id)."""
    hit = units.select("id", F.explode("community_ids").alias("c")).join(wanted.select(F.col("id").alias("c")), "c", "left_semi").select("id").distinct()
    return units.join(hit, "id", "left_semi")


# --- aggregates -------------------------------------------------------------------------------------------------------


def lower_mode(c: str) -> Column:
    """The most frequent value in lower case; the smallest of several."""
    return F.mode(F.lower(c), True)


def joined(c: str, ord_: str, sep: str) -> Column:
    """Values in the order of ord, with sep between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col(ord_).alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]), sep)


def united(c: str) -> Column:
    """SET-1: all ids of the rows' arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast("array<string>"))))))


def merge_extracted_entities(df: DataFrame) -> DataFrame:
    """AGG-1, AGG-2: one entity for each id; the first by ord gives the name."""
    return df.groupBy("id").agg(
        F.min_by("name", "ord").alias("name"), lower_mode("type").alias("type"), joined("description", "ord", "; ").alias("description"), united("text_unit_ids").alias("text_unit_ids"), F.max("confidence").alias("confidence")
    ).withColumn("frequency", F.size("text_unit_ids"))


def merge_extracted_edges(df: DataFrame) -> DataFrame:
    """AGG-1, AGG-3, AGG-10: one edge for each id, of summed weight."""
    return df.groupBy("id").agg(
        F.min_by("source_id", "ord").alias("source_id"), F.min_by("target_id", "ord").alias("target_id"), lower_mode("type").alias("type"), F.sum("weight").alias("weight"),
        joined("description", "ord", "; ").alias("description"), united("text_unit_ids").alias("text_unit_ids"),
    )


def merge_resolved_entities(df: DataFrame) -> DataFrame:
    """AGG-4: rows of one group become the entity of its commonest name (the first on a tie), described by all."""
    w = Window.partitionBy("grp")
    named = df.withColumn("__n", F.count("*").over(Window.partitionBy("grp", "name"))).withColumn("__o", F.min("ord").over(Window.partitionBy("grp", "name")))
    named = named.withColumn("__best", F.max("__n").over(w))
    named = named.withColumn("__early", F.min(F.when(F.col("__n") == F.col("__best"), F.col("__o"))).over(w))
    primary = F.when((F.col("__n") == F.col("__best")) & (F.col("__o") == F.col("__early")), F.col("ord"))
    said = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("description", F.lit("")) != "", F.struct("ord", "description")))), lambda x: x["description"]))
    return named.withColumn("__p", primary).groupBy("grp").agg(
        F.min_by("id", "__p").alias("id"), F.min_by("name", "__p").alias("name"), F.min_by("type", "__p").alias("type"), F.array_join(said, "\n").alias("description"),
        united("text_unit_ids").alias("text_unit_ids"), F.max("confidence").alias("confidence"),
    ).withColumn("frequency", F.size("text_unit_ids")).drop("grp")


def merge_resolved_edges(df: DataFrame, always: bool = False) -> DataFrame:
    """AGG-5, AGG-9: by ends and type; the weight counts distinct text units (an edge alone keeps its own, unless always);
    descriptions, where there are any, are joined, each once."""
    g = df.withColumn("type", F.lower(F.trim("type"))).groupBy("source_id", "target_id", "type")
    said = []
    if "description" in df.columns:
        each = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("description", F.lit("")) != "", F.struct("ord", "description")))), lambda x: x["description"])
        said = [F.array_join(F.array_distinct(F.flatten(F.transform(each, lambda x: F.split(x, "; ")))), "; ").alias("description")]
    out = g.agg(F.min_by("id", "ord").alias("id"), F.count("*").alias("__n"), F.sum("weight").alias("__w"), united("text_unit_ids").alias("text_unit_ids"), *said)
    counted = F.size("text_unit_ids").cast("double")
    return out.withColumn("weight", counted if always else F.when(F.col("__n") > 1, counted).otherwise(F.col("__w"))).drop("__n", "__w")


def merge_claims(df: DataFrame) -> DataFrame:
    """AGG-6, AGG-7: by subject, object (none is a value of its own) and type."""
    return df.groupBy("subject_id", "object_id", "type").agg(F.min_by("id", "ord").alias("id"), lower_mode("status").alias("status"), joined("description", "ord", "\n").alias("description"))


def merge_incremental(old: DataFrame, new: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """AGG-8: entities of both runs by key; the old id, name and type stay (the first new one's otherwise), descriptions are joined,
    each once, text units united, the largest confidence and rank taken. Also (old, new): what became of each new id."""
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)), allowMissingColumns=True).withColumn("key", key)
    first, out = F.struct("src", "id"), []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c in ("name", "type"):
            out.append(F.min_by(c, F.when(F.col(c).isNotNull(), first)).alias(c))
        elif c == "description":
            said = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("src", "id", c)))), lambda x: x["description"])
            out.append(F.array_join(F.array_distinct(F.flatten(F.transform(said, lambda x: F.split(x, "; ")))), "; ").alias(c))
        elif c == "text_unit_ids":
            out.append(united(c).alias(c))
        elif c in ("confidence", "rank"):
            out.append(F.max(c).alias(c))
    merged = both.groupBy("key").agg(F.min_by("id", first).alias("id"), *out)
    mapping = both.where("src = 1").select("key", F.col("id").alias("old")).join(merged.select("key", F.col("id").alias("new")), "key").select("old", "new")
    return merged.drop("key").withColumn("frequency", F.size("text_unit_ids")), mapping


def append_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """SET-5: rows of new that old lacks; an id that other content holds gets -delta, -delta-2 and so on."""
    fresh = new.join(old.select("id", "content"), ["id", "content"], "left_anti")
    taken = fresh.join(old.select("id").distinct().withColumn("__t", F.lit(1)), "id", "left")
    n = F.row_number().over(Window.partitionBy("id").orderBy("content")) - F.when(F.col("__t").isNull(), 1).otherwise(0)
    taken = taken.withColumn("__k", n)
    named = F.when(F.col("__k") == 0, F.col("id")).when(F.col("__k") == 1, F.concat("id", F.lit("-delta"))).otherwise(F.concat(F.col("id"), F.lit("-delta-"), F.col("__k").cast("string")))
    return taken.withColumn("id", named).drop("__t", "__k")


def merge_attributes(df: DataFrame) -> DataFrame:
    """AGG-24: for each id, the attributes of its rows; the last by ord wins."""
    each = df.select("id", "ord", F.explode("attributes").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    return each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))


def size_statistics(df: DataFrame, c: Column) -> DataFrame:
    """AGG-16: count, smallest, mean, median, largest."""
    return df.select(c.alias("x")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.max("x").alias("most"))


def chunk_quality(df: DataFrame, least: int, most: int) -> DataFrame:
    """AGG-17: empty, too long and too short chunks, and whether the lot is valid."""
    n = F.length("text")
    out = df.agg(F.count("*").alias("chunks"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(n > most).alias("oversize"), F.count_if((n < least) & (F.trim("text") != "")).alias("undersize"))
    return out.withColumn("valid", (F.col("empty") == 0) & (F.col("oversize") == 0) & (F.col("undersize") * 2 <= F.col("chunks")))


def metric_statistics(df: DataFrame, metric: str, value: str) -> DataFrame:
    """AGG-18, AGG-25: statistics of each metric; NaN counts as missing, one value deviates by 0."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(metric).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """AGG-22: equal bins from the least to the largest value."""
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    j = df.crossJoin(F.broadcast(ends))  # one row
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(c) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return j.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cited_chunks(items: DataFrame, k: int) -> DataFrame:
    """AGG-21: chunks by the number of items(ord, text_unit_ids) that cite them, first seen first on a tie."""
    each = items.select("ord", F.posexplode("text_unit_ids").alias("i", "unit")).groupBy("unit").agg(F.count("*").alias("citations"), F.min(F.struct("ord", "i")).alias("first"))
    return each.orderBy(F.desc("citations"), "first", "unit").limit(k).select("unit", "citations")


# --- windows and tops -------------------------------------------------------------------------------------------------


def top_per(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """WIN-1, WIN-4, WIN-5, TOP-1, TOP-6, FUS-5, JN-20: the first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int, first_anyway: bool = False) -> DataFrame:
    """CTX-4, WIN-3: rows of each group in order until their sizes pass the budget; with first_anyway, the first always. Rows that
    the order leaves equal are counted together, so that which of them comes first changes nothing."""
    w = Window.partitionBy(*group).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("running", F.sum(size).over(w)).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out.where((F.col("running") <= budget) | ((F.col("place") == 1) if first_anyway else F.lit(False)))


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JN-8, SET-3, SET-4, SET-7: rows of a whose keys b lacks."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """AGG-23, SET-2, SET-6: the first row, by order, of each distinct key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def with_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """JN-18: results with what was expected of their query; queries without results or truth are left out."""
    return results.join(truth, "query_id")


def lean(df: DataFrame, fields: list[str]) -> DataFrame:
    """PRJ-5: for each field the first that isn't empty of the attributes, the metadata and the row's own column."""
    own = lambda f: [F.col(f).cast("string")] if f in df.columns else []
    given = lambda c: F.when(F.trim(c) != "", c)
    return df.select("id", *[F.coalesce(*[given(x) for x in (F.try_element_at("attributes", F.lit(f)), F.try_element_at("metadata", F.lit(f)), *own(f))]).alias(f) for f in fields])


def merged_times(df: DataFrame, key: str, now: Column) -> DataFrame:
    """DAT-1: the earliest created_at of each key; updated_at is now."""
    return df.groupBy(key).agg(F.min("created_at").alias("created_at")).withColumn("updated_at", now)


def ids_of(results: DataFrame, field: str) -> DataFrame:
    """ARR-2: (id) of a metadata field over results(source, metadata map of JSON texts): an item or a list; for the field id, the
    source where there is none."""
    from loomgraph.functions.values import ensure_list

    value = F.try_element_at("metadata", F.lit(field))
    got = ensure_list(value)
    if field == "id":
        got = F.when(F.size(got) == 0, F.array("source")).otherwise(got)
    return results.select(F.explode(got).alias("id")).where("id is not null").distinct()


def stage_metrics(stages: DataFrame) -> DataFrame:
    """AGG-20: (stage, merge_rate, throughput) of stages(stage, inputs, outputs, seconds): how much smaller the output is than the
    input, and rows a second."""
    rate = F.when(F.col("inputs") > 0, 1 - F.col("outputs") / F.col("inputs")).otherwise(F.lit(0.0))
    return stages.select("stage", rate.alias("merge_rate"), F.when(F.col("seconds") > 0, F.col("outputs") / F.col("seconds")).otherwise(F.lit(0.0)).alias("throughput"))
