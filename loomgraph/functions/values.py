"""Numbers, JSON, XML, arrays and maps, with the defaults that model output needs (§2.11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c, default: float = 0.0) -> Column:
    """MTH-1."""
    return F.coalesce(F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double"), F.lit(default))


def confidence(c) -> Column:
    """MTH-2: above 1 it is on a scale of ten; kept within 0 and 1; 1 when missing."""
    x = safe_float(c, 1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 10).otherwise(x)))


def weight(strength, weight_) -> Column:
    """MTH-3."""
    return F.coalesce(strength.try_cast("double"), weight_.try_cast("double"), F.lit(1.0))


def rating(c) -> Column:
    """MTH-4: the first number in a text, within 0 and 10."""
    x = F.coalesce(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(0.0))
    return F.least(x, F.lit(10.0))


def map_score(c) -> Column:
    """MTH-5: whole points within 0 and 100; 0 when not finite."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.least(F.greatest(x, F.lit(-1e6)), F.lit(1e6)).cast("int")))


def relevance(reply, score) -> Column:
    """MTH-6: 0.4 of the score and 0.6 of the reply's number out of ten (5 when there is none)."""
    x = F.coalesce(F.regexp_extract(reply, r"\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(5.0))
    return 0.4 * F.coalesce(score, F.lit(0.0)) + 0.6 * F.least(x, F.lit(10.0)) / 10


def convergence(found_now, found_before) -> Column:
    """MTH-7: the share of findings that a round of gleaning did not add."""
    return F.when(found_now <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (found_now - found_before) / found_now))


def judge_score(reply, key: str = "score") -> Column:
    """MTH-8: from JSON, else a labelled number, else the only number; 0 otherwise; within 0 and 1."""
    labelled = F.regexp_extract(reply, rf"(?i)\"?{key}\"?\s*[:=]\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    only = F.when(F.regexp_count(reply, F.lit(r"\d+(?:\.\d+)?")) == 1, F.regexp_extract(reply, r"\d+(?:\.\d+)?", 0).try_cast("double"))
    return F.least(F.lit(1.0), F.coalesce(labelled, only, F.lit(0.0)))


def rate(part, whole) -> Column:
    """MTH-9: 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def expired(created, hours: float, now=None) -> Column:
    """DAT-2."""
    now = F.current_timestamp() if now is None else now
    return F.unix_timestamp(now) - F.unix_timestamp(created) > hours * 3600


def stamped(prefix: str, at) -> Column:
    """DAT-3."""
    return F.concat(F.lit(prefix + "-"), F.date_format(at, "yyyyMMddHHmmss"))


def json_object(c) -> Column:
    """JSN-1: the outermost braces of a reply, without fences; {} when there are none."""
    bare = F.regexp_replace(c, r"```[a-zA-Z]*", "")
    got = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(got == "", F.lit("{}")).otherwise(got)


def map_points(c) -> Column:
    """JSN-2: (description, score) of a reply's points, best first, those of no score left out."""
    p = F.from_json(json_object(c), "points array<struct<description: string, score: string>>")["points"]
    p = F.transform(F.coalesce(p, F.array().cast("array<struct<description: string, score: string>>")), lambda x: F.struct(map_score(x["score"]).alias("score"), x["description"].alias("description")))
    return F.reverse(F.array_sort(F.filter(p, lambda x: (x["score"] > 0) & (F.coalesce(x["description"], F.lit("")) != ""))))


def keywords(c) -> Column:
    """JSN-3."""
    return F.from_json(json_object(c), "high_level_keywords array<string>, low_level_keywords array<string>")


def xml_findings(c) -> Column:
    """XML-1, XML-2: (summary, explanation) of each finding, also from broken markup: tags are found one by one."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)<finding>(.*?)(?:</finding>|$)"), F.lit(1))
    inside = lambda x, tag: F.trim(F.regexp_extract(x, rf"(?s)<{tag}>(.*?)(?:</{tag}>|<|$)", 1))
    return F.transform(blocks, lambda x: F.struct(inside(x, "summary").alias("summary"), inside(x, "explanation").alias("explanation")))


def ensure_list(c) -> Column:
    """ARR-1, for a JSON text: an array's items, the value itself otherwise, nothing for null or empty."""
    items = F.from_json(c, "array<string>")
    return F.when(F.coalesce(c, F.lit("")).isin("", "null", "{}", "[]"), F.array().cast("array<string>")).when(F.startswith(F.trim(c), F.lit("[")), items).otherwise(F.array(c))


def attributes(pairs, index, filters) -> Column:
    """MAP-1: {key: value} of an array of pairs, with the chunk's own index and filters on top."""
    own = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["key"], x["value"])))
    return F.map_from_entries(F.map_entries(F.map_filter(own, lambda k, v: ~k.isin("index", "filters")))) if index is None else F.map_concat(F.map_filter(own, lambda k, v: ~k.isin("index", "filters")), F.create_map(F.lit("index"), index, F.lit("filters"), filters))
