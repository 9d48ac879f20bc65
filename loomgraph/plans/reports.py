"""Reports on communities from the finest level up (LLM-7), and what is selected for them and among them (TOP-2, TOP-3, TOP-4, TOP-7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.identity import stable_id
from loomgraph.functions.text import estimate_tokens
from loomgraph.operators.graph import both_ways, community_records, cut
from loomgraph.operators.relational import report_body, top_per, within_budget

#: Members that a report's context may name, and the tokens of it; reports of children have as many tokens of their own.
MEMBERS, BUDGET = 100, 4000


def _line(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def entity_line() -> Column:
    return _line("- ", F.col("name"), " (", F.coalesce("type", F.lit("unknown")), "): ", F.col("description"))


def _listed(lines: DataFrame, order: list[str], to: str) -> DataFrame:
    """(community, to): the lines of each community in their order, one below the other."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy("community").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(to))


def contexts(labels: DataFrame, edges: DataFrame, entities: DataFrame, children: DataFrame | None = None, members: int = MEMBERS, budget: int = BUDGET) -> DataFrame:
    """(community, entities, relations, sub_reports, truncated): what is known of each community of labels(id, community), as text.

    Its members by falling degree, the first `members` of them, as long as they fit the budget (the first anyway); the relations among
    those by the degrees of both ends, then weight, as long as they fit what is left. Where any of these had to be left out, the
    reports of its sub-communities take their place: children(community, id, name, summary, rating, size), the largest first (TOP-7), as
    long as they fit a budget of their own. Only the first members of a community are sorted and joined, however large it is.
    entities: id, name, type, description; edges: source_id, target_id, type, description, weight."""
    pairs = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit(1.0).alias("weight")).where("src <> dst")
    degree = both_ways(pairs).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"))
    m = labels.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    size = m.groupBy("community").agg(F.least(F.count("*"), F.lit(members)).alias("candidates"))
    first = top_per(m, ["community"], [F.desc("degree"), F.col("id")], members, "place").join(entities.select("id", "name", "type", "description"), "id")
    first = first.withColumn("line", entity_line()).withColumn("tokens", estimate_tokens("line").cast("long")).drop("rank")
    own = within_budget(first.drop("place"), ["community"], [F.desc("degree"), F.col("id")], F.col("tokens"), budget, first_anyway=True)
    own = cut(own.select("community", "id", "degree", "name", "line", "tokens", "place"))
    used = own.groupBy("community").agg(F.sum("tokens").alias("used"), F.count("*").alias("named"))

    a = own.select(F.col("community"), F.col("id").alias("source_id"), F.col("degree").alias("p"), F.col("name").alias("source"))
    b = own.select(F.col("community").alias("__c"), F.col("id").alias("target_id"), F.col("degree").alias("q"), F.col("name").alias("target"))
    rel = edges.join(a, "source_id").join(b, "target_id").where(F.col("community") == F.col("__c")).join(used, "community")
    line = _line("- ", F.col("source"), " -> ", F.col("target"), " (", F.coalesce("type", F.lit("related")), "): ", F.col("description"))
    rel = rel.select("community", "id", (F.col("p") + F.col("q")).alias("degrees"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "used", line.alias("line"))
    rel = rel.withColumn("tokens", estimate_tokens("line").cast("long"))
    w = Window.partitionBy("community").orderBy(F.desc("degrees"), F.desc("weight"), "id")
    rel = rel.withColumn("place", F.row_number().over(w)).withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rel = cut(rel.select("community", "place", "line", (F.col("used") + F.col("sum") <= budget).alias("fits")))
    fits = rel.where("fits")

    out = size.join(used, "community", "left").join(rel.where("not fits").select("community", F.lit(True).alias("over")).distinct(), "community", "left")
    out = out.select("community", ((F.coalesce("named", F.lit(0)) < F.col("candidates")) | F.coalesce("over", F.lit(False))).alias("truncated"))
    out = out.join(_listed(own, ["place"], "entities"), "community", "left").join(_listed(fits, ["place"], "relations"), "community", "left")
    if children is None:
        return out.select("community", F.coalesce("entities", F.lit("")).alias("entities"), F.coalesce("relations", F.lit("")).alias("relations"), F.lit("").alias("sub_reports"), "truncated")
    need = children.join(out.where("truncated").select("community"), "community", "left_semi").where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    entry = _line("- ", F.coalesce("name", F.lit("")), " (rating ", F.format_number("rating", 1), "/10): ", F.trim("summary"))
    need = need.withColumn("line", entry).withColumn("tokens", estimate_tokens("line").cast("long"))
    sub = within_budget(need, ["community"], [F.desc("size"), F.col("id")], F.col("tokens"), budget, first_anyway=True)
    out = out.join(_listed(sub.select("community", "place", "line"), ["place"], "sub_reports"), "community", "left")
    return out.select("community", *[F.coalesce(c, F.lit("")).alias(c) for c in ("entities", "relations", "sub_reports")], "truncated")


def template(records: DataFrame, context: DataFrame, top: int = 10) -> DataFrame:
    """The offline report: its name from the first three members of the context, a finding for each of the first `top` members, and
    one for what the sub-communities' reports say. records: community, size, rank and more; context: as contexts() gives it."""
    j = records.join(context, "community")
    lines = F.filter(F.split("entities", "\n"), lambda x: F.startswith(x, F.lit("- ")))
    names = F.transform(F.slice(lines, 1, top), lambda x: F.regexp_extract(x, r"^- (.*?) \(", 1))
    linked = lambda x: F.size(F.filter(F.split("relations", "\n"), lambda y: F.contains(y, F.concat(F.lit(" "), x, F.lit(" ")))))
    each = F.transform(names, lambda x: F.struct(x.alias("summary"), F.concat(x, F.lit(" has "), linked(x).cast("string"), F.lit(" of the listed relations.")).alias("explanation")))
    sub = F.when(F.col("sub_reports") != "", F.array(F.struct(F.lit("Groups within").alias("summary"), F.col("sub_reports").alias("explanation"))))
    findings = F.concat(each, F.coalesce(sub, F.array().cast("array<struct<summary:string,explanation:string>>")))
    title = F.array_join(F.slice(names, 1, 3), ", ")
    rating = F.least(F.lit(10.0), F.round(F.log1p("rank"), 1))
    summary = F.concat(F.lit("A group of "), F.col("size").cast("string"), F.lit(" entities around "), title, F.lit("."))
    return j.select("community", title.alias("name"), summary.alias("summary"), rating.alias("rating"), report_body(title, rating, F.lit("degree"), summary, findings).alias("full_content"))


def bottom_up(hierarchy: DataFrame, edges: DataFrame, entities: DataFrame, write: Callable = template, members: int = MEMBERS, budget: int = BUDGET) -> DataFrame:
    """Reports for every level of hierarchy(level, id, community, parent), one level after the other: those of a level are written
    when all of the level below are there to stand in for what doesn't fit. write: makes (community, name, summary, rating,
    full_content) from the records and the contexts of one level. A level is a few joins over all its communities at once."""
    pairs = cut(edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight"))
    levels = sorted(r.level for r in hierarchy.select("level").distinct().collect())  # a few
    out, below = None, None
    for level in levels:
        labels = cut(hierarchy.where(F.col("level") == level).select("id", "community"))
        children = None
        if below is not None:
            up = hierarchy.where(F.col("level") == level - 1).where("parent is not null").select(F.col("community").alias("community_id"), F.col("parent").alias("community")).distinct()
            children = below.join(up, "community_id")
        records = cut(community_records(labels, pairs, entities))
        made = write(records, cut(contexts(labels, edges, entities, children, members, budget)))
        done = made.join(records.select("community", "rank", "size"), "community")
        done = cut(done.select(stable_id(F.concat(F.lit(f"report:{level}:"), F.col("community"))).alias("id"), F.lit(level).alias("level"), F.col("community").alias("community_id"), "name", "summary", "rating", "rank", "size", "full_content"))
        out, below = done if out is None else out.union(done), done
    return out


def selected(reports: DataFrame, n: int) -> DataFrame:
    """TOP-2: without scores for a query, the n reports of the highest rank, then rating; missing ones last."""
    return reports.orderBy(F.desc(F.coalesce("rank", F.lit(0))), F.desc(F.coalesce("rating", F.lit(0.0))), "id").limit(n)


def listed_entities(entities: DataFrame, group: list[str], most: int) -> DataFrame:
    """TOP-3: (group, listed): names for a prompt. Of more than `most`, those with a description first, then by their text units, and
    how many more there are."""
    described = F.trim(F.coalesce("description", F.lit(""))) != ""
    e = entities.withColumn("described", described.cast("int")).withColumn("units", F.greatest(F.size(F.coalesce("text_unit_ids", F.array().cast("array<string>"))), F.lit(0)))
    return _with_rest(e, group, [F.desc("described"), F.desc("units"), F.col("name"), F.col("id")], F.col("name"), most, "entities")


def listed_relations(relations: DataFrame, group: list[str], most: int) -> DataFrame:
    """TOP-4: (group, listed): relations(source, target, type, description, weight, id) for a prompt. Of more than `most`, the heaviest
    first, then those with a description, and how many more there are."""
    r = relations.withColumn("described", (F.trim(F.coalesce("description", F.lit(""))) != "").cast("int")).withColumn("w", F.coalesce("weight", F.lit(0.0)))
    return _with_rest(r, group, [F.desc("w"), F.desc("described"), F.col("id")], _line("'", F.col("source"), "' -> '", F.col("target"), "' (type: '", F.col("type"), "')"), most, "relationships")


def _with_rest(df: DataFrame, group: list[str], order: list[Column], line: Column, most: int, what: str) -> DataFrame:
    n = df.groupBy(*group).agg(F.count("*").alias("n"))
    first = top_per(df.withColumn("line", line), group, order, most, "place").groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    rest = F.when(F.col("n") > most, F.concat(F.lit("\n... and "), (F.col("n") - most).cast("string"), F.lit(f" more {what}"))).otherwise("")
    return n.join(first, group).select(*group, F.concat("lines", rest).alias("listed"))
