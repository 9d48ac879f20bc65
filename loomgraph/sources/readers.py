"""Scans (§2.1)."""

from __future__ import annotations

import functools
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Suffixes that are read, and paths that are left out.
TEXT_SUFFIXES = ("csv", "txt", "md", "markdown", "html", "htm", "json")
EXCLUDED = [r"/\.[^/]*$", r"/\.[^/]*/", r"\.pyc$", r"/__pycache__/"]

READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def reader(*suffixes: str):
    """SRC-2, EXT-1: registers a function from files(path, content, ...) to a column text for these suffixes."""

    def add(f):
        for s in suffixes:
            if s in READERS:
                raise ValueError(f"{s} has a reader")
            READERS[s] = f
        return f

    return add


@pandas_udf(StringType())
def _marked(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else b.decode("utf-16", "replace"))


def decode(content) -> Column:
    """SRC-3: UTF-8, else UTF-16 where a mark says so, else Latin-1; without a leading byte order mark. Only files in UTF-16
    leave the JVM."""
    c = F.col(content) if isinstance(content, str) else content
    mark = F.hex(F.substring(c, 1, 2)).isin("FFFE", "FEFF")
    text = c.cast("string")
    plain = F.when(F.hex(F.substring(c, 1, 3)) == "EFBBBF", F.substring(text, 2, 1 << 30)).otherwise(text)
    return F.when(F.is_valid_utf8(text), plain).when(mark, _marked(F.when(mark, c))).otherwise(F.decode(c, "ISO-8859-1"))


@reader("csv", "txt", "md", "markdown")
def _plain(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decode("content"))


@reader("html", "htm")
def _html(files: DataFrame) -> DataFrame:
    t = F.regexp_replace(decode("content"), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(br|/p|/h[1-6]|/div|/li)[^>]*>", "\n"), r"<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return files.withColumn("text", F.regexp_replace(t, r"^\s+|\s+$", ""))


@reader("json")
def _json(files: DataFrame) -> DataFrame:
    """SRC-4: a parsed document's content, or its pages' texts with blank lines between (SRC-5, SRC-6)."""
    d = F.from_json(decode("content"), "content struct<text: string>, page_content string, pages array<struct<text: string, page_content: string>>")
    pages = F.array_join(F.filter(F.transform(d["pages"], lambda p: F.coalesce(p["text"], p["page_content"])), lambda x: x.isNotNull()), "\n\n")
    return files.withColumn("text", F.coalesce(d["content"]["text"], d["page_content"], pages))


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """SRC-1: files below a folder with a suffix that has a reader, without hidden ones. No content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = f.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("suffix").isin(*(suffixes or tuple(READERS))))
    root = urlsplit(folder).path if "://" in folder else folder.removeprefix("file:")
    below = F.concat(F.lit("/"), F.substring_index("path", root.rstrip("/") + "/", -1))  # hidden folders above the given one don't count
    for x in EXCLUDED:
        f = f.where(~below.rlike(x))
    return f


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC-7: (documents, failed): documents(doc_id, file_path, suffix, text, content_hash), and files that gave no text."""
    from loomgraph.functions.identity import content_hash, path_id

    files = discover(spark, folder)
    # Only suffixes that occur are scanned, as each reader opens all files that are listed.
    there = {r[0] for r in files.select("suffix").distinct().collect()}
    parts = [f(files.where(F.col("suffix") == s)).select("path", "suffix", "text") for s, f in sorted(READERS.items()) if s in there or s == "txt"]
    out = functools.reduce(DataFrame.unionByName, parts)
    ok = F.coalesce(F.trim("text"), F.lit("")) != ""
    docs = out.where(ok).select(path_id(F.col("path")).alias("doc_id"), F.col("path").alias("file_path"), "suffix", "text", content_hash(F.col("text"), 32).alias("content_hash"))
    return docs, out.where(~ok).select(F.col("path").alias("file_path"), F.lit("no text").alias("error_info"))


def digest_of(files: DataFrame) -> str:
    """Of files(path, time, length): two sums of hashes, which don't depend on the order, with their number, hashed once more.
    Sums are formed in the tasks, whatever the number of files."""
    each = [F.xxhash64(F.lit(k), "path", "time", "length").cast("decimal(38, 0)") for k in (0, 1)]
    n, a, b = files.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0)) for x in each]).first()
    import hashlib

    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()[:16]


def fingerprint(spark: SparkSession, folder: str) -> str:
    """SRC-8: of the names, times and sizes of all files, whatever their content."""
    return digest_of(discover(spark, folder).select("path", F.col("modificationTime").cast("long").alias("time"), "length"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: questions with an id (query_id, id or q_ and the place), what is expected, and metadata."""
    schema = "query_id string, id string, question string, answer string, category string, difficulty string, metadata map<string, string>, expected_entities array<string>, expected_relationships array<string>, reference_sources array<string>"
    d = spark.read.schema(schema).json(path, multiLine=True).withColumn("i", F.monotonically_increasing_id())
    meta = F.map_filter(F.create_map(F.lit("category"), "category", F.lit("difficulty"), "difficulty"), lambda k, v: v.isNotNull())
    own = F.coalesce("metadata", F.create_map().cast("map<string, string>"))
    meta = F.map_concat(F.map_filter(meta, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    truth = F.col("answer").isNotNull() | (F.size(F.coalesce("expected_entities", F.array())) > 0) | (F.size(F.coalesce("expected_relationships", F.array())) > 0)
    d = d.where(F.coalesce("question", F.lit("")) != "")
    return d.select(F.coalesce("query_id", "id", F.concat(F.lit("q_"), F.col("i").cast("string"))).alias("query_id"), "question", "answer", meta.alias("metadata"), "expected_entities", "expected_relationships", truth.alias("has_truth"))


def graph_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-10: nodes, edges, layout(id, x, y) and communities(id, community_id, level) of an exported graph."""
    d = spark.read.json(path, multiLine=True)
    out = {"nodes": d.select(F.explode("nodes").alias("n")).select("n.*"), "edges": d.select(F.explode("edges").alias("e")).select("e.*")}
    own = spark.read.text(path, wholetext=True)
    if "layout" in d.columns:
        at = F.from_json("value", "layout map<string, array<double>>")["layout"]
        out["layout"] = own.select(F.explode(at).alias("id", "p")).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    if "communities" in d.columns:
        of = F.from_json("value", "communities struct<hierarchy: array<struct<community_id: string, level: int, nodes: array<string>>>>")["communities"]["hierarchy"]
        c = own.select(F.explode(of).alias("c"))
        out["communities"] = c.select(F.explode("c.nodes").alias("id"), F.col("c.community_id").alias("community_id"), F.col("c.level").alias("level"))
    return out


def configuration(path: str, defaults: dict, environment: dict[str, str] | None = None, prefix: str = "LOOMGRAPH") -> dict:
    """SRC-11, on the driver: defaults, with a file's values on top (YAML where that library is there, else JSON), and on top of
    these the variables PREFIX__SECTION__KEY, whose values are read as JSON where they can be. Unknown keys are errors."""
    import copy
    import json
    import os

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        given = yaml.safe_load(text) or {}
    except ImportError:
        given = json.loads(text or "{}")
    out = copy.deepcopy(defaults)

    def lay(onto: dict, values: dict, at: str) -> None:
        for k, v in values.items():
            if k not in onto:
                raise ValueError(f"unknown setting {at}{k}")
            if isinstance(onto[k], dict) and isinstance(v, dict):
                lay(onto[k], v, f"{at}{k}.")
            else:
                onto[k] = v

    lay(out, given, "")
    for name, value in sorted((os.environ if environment is None else environment).items()):
        if name.startswith(prefix + "__"):
            try:
                value = json.loads(value)
            except ValueError:
                pass
            for k in reversed(name.lower().split("__")[1:]):
                value = {k: value}
            lay(out, value, "")
    return out


def parse_filter(text: str) -> dict[str, str]:
    """STR-21: key:value, parted at the first colon."""
    key, colon, value = text.partition(":")
    if not colon or not key.strip():
        raise ValueError(f"not a filter: {text!r}")
    return {key.strip(): value.strip()}


def tuning_sample(docs: DataFrame, n: int = 20, chars: int = 8000) -> DataFrame:
    """SRC-12: the first n documents, up to so many characters in all."""
    from loomgraph.operators.relational import within_budget

    return within_budget(docs.orderBy("doc_id").limit(n), [], [F.col("doc_id")], F.length("text"), chars, first_anyway=True)
