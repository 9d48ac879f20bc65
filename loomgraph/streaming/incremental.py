"""Incremental indexing, conversation memory, and their streaming forms (§2.16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.identity import content_hash
from loomgraph.sources.writers import Store


def registry(docs: DataFrame, id: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """INC-1: (doc_id, content_hash); of rows with one id the last by order."""
    h = content_hash(F.coalesce(F.col(text), F.lit("")), 32)
    return docs.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(F.max_by(h, F.col(order) if order else h).alias("content_hash"))


def diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """INC-2, JN-7: (doc_id, change_type): new, changed, unchanged or deleted; every id once."""
    j = stored.withColumnRenamed("content_hash", "old").join(incoming.withColumnRenamed("content_hash", "new"), "doc_id", "full_outer")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return j.select("doc_id", kind.alias("change_type"))


def to_process(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """FLT-11."""
    return docs.join(changes.where(F.col("change_type").isin("new", "changed")).select("doc_id"), "doc_id", "left_semi")


def exclusive(lineage: DataFrame, leaving: DataFrame) -> DataFrame:
    """JN-8, INC-3: (id) artifacts of lineage(doc_id, id) that only documents in leaving(doc_id) have."""
    gone = lineage.join(leaving.select("doc_id"), "doc_id", "left_semi").select("id").distinct()
    kept = lineage.join(leaving.select("doc_id"), "doc_id", "left_anti").select("id").distinct()
    return gone.join(kept, "id", "left_anti")


def commit(store: Store, docs: DataFrame, artifacts: dict[str, DataFrame], lineage: DataFrame | None = None) -> DataFrame:
    """INC-3..7: removes what only changed and deleted documents had, upserts the delta, and writes the registry last, so
    that a run that broke off is done again. Without a registry all documents are new (INC-6). Returns the changes."""
    now = registry(docs)
    before = store.read("doc_status").select("doc_id", "content_hash") if store.exists("doc_status") else now.limit(0)
    changes = diff(before, now)
    if lineage is not None:
        gone = exclusive(lineage, changes.where(F.col("change_type").isin("changed", "deleted")))
        for name in artifacts:
            if store.exists(name):
                store.delete(name, gone)
    for name, df in artifacts.items():
        store.upsert(name, df)
    store.replace("doc_status", now.withColumn("status", F.lit("processed")))
    return changes


def watch(spark, folder: str, schema, store: Store, build, checkpoint: str):
    """Structured Streaming: new files in a folder, each micro-batch indexed by build(docs) -> {table: rows}. Deleted files are
    seen only by a batch diff. Writing the same batch again changes nothing, as ids are stable."""
    docs = spark.readStream.schema(schema).parquet(folder)

    def one(batch: DataFrame, _: int) -> None:
        for name, df in build(batch).items():
            store.upsert(name, df)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """INC-10: events by window and type; the same plan over a table or a stream, where later rows than `late` are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


# --- conversation memory ----------------------------------------------------------------------------------------------


def recent(messages: DataFrame, n: int = 20) -> DataFrame:
    """INC-8, WIN-5: the last n messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def named(text: str) -> Column:
    """The names of a text: words of four letters or more with a capital first."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{L}{3,})"), F.lit(1))


def memory(messages: DataFrame, n: int = 20, focus: int = 5) -> DataFrame:
    """INC-8: for each conversation how many messages are recent, the names they mention, and the first few of the last user
    message. streaming/memory.py keeps the same over a stream."""
    m = recent(messages, n).withColumn("names", named("text"))
    last = F.max_by("names", F.when(F.col("role") == "user", F.col("turn")))
    return m.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("mentioned"), F.slice(F.array_distinct(last), 1, focus).alias("focus"), F.max("turn").alias("last_turn"))


def evict(conversations: DataFrame, keep: int = 100) -> DataFrame:
    """WIN-8: the conversations that were used last."""
    return conversations.orderBy(F.desc("last_turn"), "conv_id").limit(keep)


def resume(done: list[str], stages: list[str], start: str | None = None) -> list[str]:
    """INC-9: the stages still to run: from the first that is not done, or from a named one."""
    if start is not None:
        return stages[stages.index(start) :]
    return next((stages[i:] for i, s in enumerate(stages) if s not in done), [])
