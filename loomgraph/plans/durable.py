"""Durable calls of models (LLM-18, EMB-1): what was asked once is not asked again.

A reply is kept in a table of the store by a hash of the model's name and the prompt. ask() takes distinct prompts, leaves out
those that have a reply by an anti-join, calls the model for the rest in tasks, and stores what came back before anybody reads
it, so that lost executors, later stages, updates and reruns find it there. Failures have their error beside the row of their
key and aren't stored: the next run asks for them again.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut
from loomgraph.sources.writers import Store


@dataclass(frozen=True)
class Limits:
    """Prompts of one call, calls at once in a task, seconds that a call may take, tries of a prompt by itself, and the first pause
    between them (it doubles, and is drawn from half to all of that)."""

    batch: int = 10
    at_once: int = 4
    seconds: float = 300.0
    tries: int = 3
    pause: float = 0.5


def calls(call: Callable[[list[str]], list], limits: Limits = Limits()) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over (key, prompt): (key, reply, error), a row for each, in order. A batch that fails or takes too long is
    tried prompt by prompt; a prompt that fails for good has a null reply and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(limits.at_once)

        def timed(prompts: list[str]) -> list:
            # A call that hangs can't be stopped; it is left to its thread, and the pool for such calls grows by one.
            one = ThreadPoolExecutor(1)
            try:
                got = one.submit(call, prompts).result(limits.seconds)
            finally:
                one.shutdown(wait=False, cancel_futures=True)
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} replies to {len(prompts)} prompts")
            return list(got)

        def single(prompt: str):
            error = ""
            for i in range(limits.tries):
                try:
                    return timed([prompt])[0], None
                except Late:
                    error = f"no reply within {limits.seconds} s"
                except Exception as e:  # noqa: BLE001  whatever a model raises
                    error = f"{type(e).__name__}: {e}"
                if i + 1 < limits.tries:
                    time.sleep(limits.pause * 2**i * random.uniform(0.5, 1))
            return None, error

        def several(prompts: list[str]) -> list:
            try:
                return [(r, None) for r in timed(prompts)]
            except Exception:  # noqa: BLE001
                return [single(p) for p in prompts]

        try:
            for df in batches:
                parts = [list(df["prompt"][i : i + limits.batch]) for i in range(0, len(df), limits.batch)]
                got = [x for part in pool.map(several, parts) for x in part]
                yield pd.DataFrame({"key": df["key"].to_numpy(), "reply": [r for r, _ in got], "error": [e for _, e in got]})
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


class Replies:
    """The kept replies of one model. call: the replies to a list of prompts; kind: the type of a reply."""

    def __init__(self, store: Store, model: str, call: Callable[[list[str]], list], kind: str = "string", limits: Limits = Limits(), tasks: int | None = None):
        self.store, self.model, self.call, self.kind, self.limits, self.tasks = store, model, call, kind, limits, tasks
        self.table = "replies." + re.sub(r"[^A-Za-z0-9_.]", "_", model)

    def ask(self, rows: DataFrame) -> DataFrame:
        """rows(key, prompt) with reply and error; null prompts have a null reply."""
        rows = cut(rows.select("key", "prompt", F.sha2(F.concat_ws("\n", F.lit(self.model), "prompt"), 256).alias("hash")))
        new = rows.where("prompt is not null").select(F.col("hash").alias("key"), "prompt").dropDuplicates(["key"])
        if self.store.exists(self.table):
            new = new.join(self.store.read(self.table).select(F.col("hash").alias("key")), "key", "left_anti")
        new = cut(new)
        n = new.count()
        if n:
            tasks = self.tasks or max(1, min(new.sparkSession.sparkContext.defaultParallelism, -(-n // self.limits.batch)))
            got = cut(new.repartition(tasks).mapInPandas(calls(self.call, self.limits), f"key string, reply {self.kind}, error string"))
            good = got.where("reply is not null").select(F.col("key").alias("hash"), "reply")
            self.store.upsert(self.table, good, "hash")
            failed = got.where("reply is null").select(F.col("key").alias("hash"), "error")
        else:
            failed = self.store.spark.createDataFrame([], "hash string, error string")
        if not self.store.exists(self.table):
            return rows.join(failed, "hash", "left").select("key", "prompt", F.lit(None).cast(self.kind).alias("reply"), "error")
        kept = self.store.read(self.table)
        return rows.join(kept, "hash", "left").join(failed, "hash", "left").select("key", "prompt", "reply", "error")


class Embedder:
    """EMB-1: embed(df, text) whose vectors are kept by content, model and dimension. call: vectors of a list of texts."""

    def __init__(self, store: Store, model: str, call: Callable[[list[str]], list], dimension: int, limits: Limits = Limits(batch=64)):
        self.dimension = dimension
        self.replies = Replies(store, f"{model}.{dimension}", call, "array<double>", limits)

    def __call__(self, df: DataFrame, text: str) -> DataFrame:
        """df with a column embedding. Null and empty texts have a vector of zeros; so have texts whose call failed for good."""
        zeros = F.array_repeat(F.lit(0.0), self.dimension)
        own = df.select(F.col(text).alias("prompt")).where(F.coalesce(F.col(text), F.lit("")) != "").distinct()
        got = self.replies.ask(own.select(F.col("prompt").alias("key"), "prompt")).select(F.col("key").alias("__t"), F.col("reply").alias("embedding"))
        return df.join(got, F.col(text) == F.col("__t"), "left").drop("__t").withColumn("embedding", F.coalesce("embedding", zeros))


def extractor(replies: Replies, prompt: Callable | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """LLM-1 by a model: one call for each distinct text unit gives its entities and its relations, as JSON: {"entities": [{"name", "type",
    "description"}], "relations": [{"source", "target", "type", "description"}]}. A reply that isn't, or none, is an empty one."""
    from loomgraph.functions.identity import entity_id, relationship_id
    from loomgraph.functions.text import normalize_name
    from loomgraph.operators.relational import merge_extracted_edges, merge_extracted_entities
    from loomgraph.plans import extract as X

    kind = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string,description:string>>"
    ask = prompt or (lambda text: X.prompt("extract", text=text))

    def run(units: DataFrame) -> tuple[DataFrame, DataFrame]:
        u = units.select(X.text_unit_key("document_id", "number").alias("key"), "text", F.struct("document_id", "number").alias("ord"))
        got = replies.ask(u.select("key", ask(F.col("text")).alias("prompt"))).select("key", F.from_json("reply", kind).alias("x"))
        got = cut(got.join(u.select("key", "ord"), "key"))
        e = got.select("key", "ord", F.explode("x.entities").alias("e")).where("trim(e.name) <> ''")
        name = normalize_name(F.col("e.name"))
        ents = e.select(entity_id(name).alias("id"), name.alias("name"), F.coalesce("e.type", F.lit("TERM")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"), F.array("key").alias("text_unit_ids"), F.lit(1.0).alias("confidence"), "ord")
        r = got.select("key", "ord", F.explode("x.relations").alias("r")).where("trim(r.source) <> '' and trim(r.target) <> ''")
        s, d, t = normalize_name(F.col("r.source")), normalize_name(F.col("r.target")), F.coalesce("r.type", F.lit("RELATED"))
        edges = r.select(relationship_id(s, d, t).alias("id"), entity_id(s).alias("source_id"), entity_id(d).alias("target_id"), t.alias("type"), F.lit(1.0).alias("weight"), F.coalesce("r.description", F.lit("")).alias("description"), F.array("key").alias("text_unit_ids"), "ord")
        ents, edges = merge_extracted_entities(ents), merge_extracted_edges(edges.where("source_id <> target_id"))
        known = ents.select("id")
        edges = edges.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return ents, edges

    return run


def writer(replies: Replies, field: str, prompt: Callable) -> Callable[[DataFrame], DataFrame]:
    """A model that fills the column `field` of rows(key, ...) with its reply to prompt(columns of the row); rows without one keep what
    they have. For summaries (LLM-4), reports (LLM-7) and answers (LLM-13)."""

    def run(df: DataFrame) -> DataFrame:
        key = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != field])), 256)
        d = cut(df.withColumn("__key", key))
        got = replies.ask(d.select(F.col("__key").alias("key"), prompt(d).alias("prompt")).dropDuplicates(["key"])).select(F.col("key").alias("__key"), F.col("reply").alias("__reply"))
        new = F.coalesce("__reply", F.col(field)) if field in df.columns else F.col("__reply")
        return d.join(got, "__key", "left").withColumn(field, new).drop("__key", "__reply")

    return run
