"""Conversation memory as state of a stream (INC-8, WIN-8): what incremental.memory() gives over a table, kept up to date."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.sources.writers import Store
from loomgraph.streaming.incremental import named

#: What the state needs, and that timers fire with the next messages: else a stream with timers asks for batches without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
MESSAGE = "turn long, role string, names array<string>"


class _Memory(StatefulProcessor):
    """The last n messages of a conversation by turn, in a list state of that length whatever arrives at once. A conversation that
    is silent for `idle` milliseconds goes: its timer says so in a last row, and its messages have no longer to live."""

    def __init__(self, n: int, focus: int, idle: int):
        self.n, self.focus, self.idle = n, focus, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a little longer than the timer, so that messages are never gone while their conversation is still told of
        self.messages = handle.getListState("messages", MESSAGE, ttlDurationMs=2 * self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        def all_():
            yield from self.messages.get()
            yield from ((r.turn, r.role, list(r.names)) for r in rows)

        last = heapq.nlargest(self.n, all_(), key=lambda m: m[0])[::-1]
        self.messages.put([(m[0], m[1], list(m[2])) for m in last])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        said = [list(dict.fromkeys(m[2])) for m in last if m[1] == "user"]
        mentioned = sorted({x for m in last for x in m[2]})
        yield Row(conv_id=key[0], messages=len(last), mentioned=mentioned, focus=said[-1][: self.focus] if said else None, last_turn=last[-1][0], evicted=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.messages.clear()
        yield Row(conv_id=key[0], messages=0, mentioned=[], focus=None, last_turn=None, evicted=True)

    def close(self) -> None:
        pass


def memories(messages: DataFrame, n: int = 20, focus: int = 5, idle: int = 24 * 3600 * 1000) -> DataFrame:
    """(conv_id, messages, mentioned, focus, last_turn, evicted) of each conversation that a micro-batch of the stream
    messages(conv_id, turn, role, text) touches, or that was silent for idle milliseconds (evicted). Rows without a
    conversation or turn are left out; texts and roles may be null. Turns may arrive late: the last n are by turn. The query
    that writes it runs under SETTINGS."""
    m = messages.where("conv_id is not null and turn is not null")
    m = m.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce(named("text"), F.array()).alias("names"))
    schema = f"conv_id {m.schema['conv_id'].dataType.simpleString()}, messages long, mentioned array<string>, focus array<string>, last_turn long, evicted boolean"
    return m.groupBy("conv_id").transformWithState(_Memory(n, focus, idle), schema, "Update", "ProcessingTime")


def remember(messages: DataFrame, store: Store, checkpoint: str, name: str = "memory", **options):
    """A query that keeps the table `name`, one row for each conversation that is remembered. State and place lie in the
    checkpoint; writing a micro-batch again after a loss changes nothing, as rows have their conversation as key."""

    def one(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}-touched")  # both changes see one run of the state
        rows = store.spark.read.schema(batch.schema).parquet(f"{checkpoint}-touched")
        if not store.exists(name):
            store.replace(name, rows.where("not evicted").drop("evicted"), key="conv_id")
        else:
            store.upsert(name, rows.where("not evicted").drop("evicted"), key="conv_id")
            store.delete(name, rows.where("evicted").select(F.col("conv_id").alias("id")), key="conv_id")

    conf = store.spark.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            conf.set(k, v)
        out = memories(messages, **options).writeStream.outputMode("update").foreachBatch(one)
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # with a copy of the settings
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
