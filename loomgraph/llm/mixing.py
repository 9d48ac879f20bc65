"""Mixing sources to target weights by hash-threshold histograms.

Method. Every document has a hash of its id. Tokens are summed by source and hash bucket; the bucket in which a source's
budget ends is refined alone, by the next bits of the hash, until it holds no two hashes. A document is taken when its
hash lies below its source's threshold: a filter, no sort. What the document at the threshold leaves of the budget is
given, by two further nested thresholds, to documents that fit into it. Only whole documents are taken, so a source's
words come within a few words of its target where it has small documents left.

A source whose target is its size or more takes all its documents once and the rest of the budget as second copies.

Cases. Null text: size 0, taken 0. Null source: a source of its own, last in the order. Null ids share one hash, as
repeated ids do, and are taken or left together. An empty table gives an empty result. A run depends on nothing but ids,
sources and sizes, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, Words, chunks, in_arrow

HASH_BITS, STEP_BITS, LEVELS = 60, 12, 3
#: A row for each source is broadcast up to this many sources (about 60 bytes each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 200_000


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """(id, source, size, h): words [^\\x20\\x09-\\x0D]+ of each text, and a 60-bit hash of the id. With carry also docs' own
    columns, as __0, __1 and so on."""

    def run(batches):
        for batch in batches:
            n = [np.empty(0, np.int64)]
            n += [Words(b, o, False, hashed=False).count for _, b, o in chunks(batch.column(2))]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != 2]
            yield pa.record_batch([*rest, pa.array(np.concatenate(n).astype(np.int64))], names=[*(x for x in names if x != "text"), "size"])

    names = ["id", "source", "text", *(f"__{i}" for i in range(len(docs.columns) if carry else 0))]
    d = docs.select(F.col(id), F.col(source), F.col(text), *(docs.columns if carry else [])).toDF(*names)
    counted = d.transform(in_arrow, run, d.drop("text").schema.add("size", "long"))
    return counted.withColumn("h", F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target). Sources by code point, null last, have weights in turn and share `share` times all
    sizes by weight; a target stops at `most` times its source's size and the excess goes to the others.

    The sources that reach their stop are those with the least stop per weight, so one pass in that order finds the level
    that the others share. One row for each source goes through one task here.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("stop", most * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(earlier), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct(F.row_number().over(order).alias("i"), "level"))).over(every)["level"])
    target = F.coalesce(F.least(F.col("level") * F.col("w"), F.col("stop")), F.col("stop"))
    return s.select("source", "source_size", target.alias("target"))


def _threshold(scratch: Scratch, sized: DataFrame, state: DataFrame, level: int, eligible: Column, near) -> DataFrame:
    """state with t{level}: documents of this level with h below it fit into the source's column budget; and with the
    budget that is left. near: how a state is joined to documents."""
    shift = HASH_BITS - STEP_BITS
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("rest", F.col("budget")).withColumn("done", F.col("budget") <= 0).withColumn("t", F.lit(0).cast("long"))
    state = scratch.table(state)
    while True:
        d = sized.alias("d").join(near(state.where("not done").alias("s")), F.col("d.source").eqNullSafe(F.col("s.source")))
        d = d.where(eligible & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix")))
        d = d.groupBy(F.col("d.source").alias("source"), F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.countDistinct("h").alias("hashes") if shift else F.lit(1).alias("hashes"), F.min("h").alias("h"))
        d = d.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        before = F.col("upto") - F.col("n")
        b = state.where("not done").select("source", "rest").alias("b")
        d = d.alias("d").join(near(b), F.col("d.source").eqNullSafe(F.col("b.source")))
        end = d.groupBy(F.col("d.source").alias("source")).agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", before.alias("before"), "hashes", "h"))).alias("end"), F.sum("n").alias("all")
        )
        j = state.alias("s").join(end.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
        fits, last = F.col("end").isNull(), (F.col("end.hashes") <= 1)
        left = F.when(fits, F.col("rest") - F.coalesce("all", F.lit(0))).otherwise(F.col("rest") - F.col("end.before"))
        # Where nothing is over the budget all that came under the prefix is taken; else the bucket that is over is next.
        top = F.shiftleft(F.col("prefix") + 1, shift + STEP_BITS)
        state = j.select(
            *[F.col(f"s.{c}") for c in state.columns if c not in ("prefix", "rest", "done", "t")],
            F.when(F.col("done") | fits, F.col("prefix")).otherwise(F.col("end.bucket")).alias("prefix"),
            F.when(F.col("done"), F.col("rest")).otherwise(left).alias("rest"),
            (F.col("done") | fits | last).alias("done"),
            F.when(F.col("done"), F.col("t")).when(fits, top).otherwise(F.col("end.h")).alias("t"),
        )
        state = scratch.table(state)
        if not shift or not state.where("not done").take(1):
            return state.withColumnRenamed("t", f"t{level}").drop("budget", "prefix", "done").withColumnRenamed("rest", "budget")
        shift -= STEP_BITS


def _mixed(docs: DataFrame, id: str, text: str, source: str, weights: tuple[float, ...], share: float, most: float, carry: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.table(sizes(docs, id, text, source))
    state = scratch.table(targets(sized, weights, share, most))
    near = F.broadcast if state.count() <= BROADCAST_SOURCES else (lambda x: x)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("times", times).withColumn("budget", F.floor("target").cast("long") - F.col("times") * F.col("source_size"))
    chosen, open_ = F.lit(False), F.col("size") > 0
    for level in range(1, LEVELS + 1):
        state = state.withColumn(f"room{level}", F.col("budget"))
        fits = open_ & ~chosen & (F.col("size") <= F.col(f"room{level}")) if level > 1 else open_
        state = _threshold(scratch, sized, state, level, fits, near)
        chosen = chosen | (fits & (F.col("h") < F.col(f"t{level}")))
    # With carry the sizes are counted again, on the rows themselves, which so need no join.
    d = (sizes(docs, id, text, source, carry=True) if carry else sized).alias("d").join(near(state.alias("s")), F.col("d.source").eqNullSafe(F.col("s.source")))
    return d.withColumn("copies", F.col("times") + F.when(chosen, 1).otherwise(0))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs: the document is taken `copies` times, 0 to 2."""
    d = _mixed(docs, id, text, source, weights, share, most, carry=False)
    return d.select(F.col("d.id").alias(id), F.col("d.source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken. Rows without words, of no size, stay once."""
    d = _mixed(docs, id, text, source, weights, share, most, carry=True)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    d = d.where(times > 0).withColumn("__each", F.explode(F.sequence(F.lit(1), times)))
    return d.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0 * source_size::DOUBLE AS stop, row_number() OVER (ORDER BY 2.0 * source_size::DOUBLE / w, source NULLS LAST) AS i FROM s),
l AS (
  SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
t AS (
  SELECT source, source_size, least(stop, w * (SELECT arg_min(level, i) FROM l WHERE level * w <= stop)) AS target FROM l),
b AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times,
         CAST(floor(target) AS BIGINT) - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size AS room1
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
l1 AS (SELECT *, size > 0 AND sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= room1 AS c1 FROM b),
r1 AS (SELECT *, room1 - coalesce(sum(size) FILTER (WHERE c1) OVER (PARTITION BY source), 0) AS room2 FROM l1),
l2 AS (SELECT *, size > 0 AND NOT c1 AND size <= room2 AND sum(CASE WHEN size > 0 AND NOT c1 AND size <= room2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= room2 AS c2 FROM r1),
r2 AS (SELECT *, room2 - coalesce(sum(size) FILTER (WHERE c2) OVER (PARTITION BY source), 0) AS room3 FROM l2),
l3 AS (SELECT *, size > 0 AND NOT c1 AND NOT c2 AND size <= room3 AND sum(CASE WHEN size > 0 AND NOT c1 AND NOT c2 AND size <= room3 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= room3 AS c3 FROM r2)
SELECT doc_id, size, source_size, target, size * (times + CASE WHEN c1 OR c2 OR c3 THEN 1 ELSE 0 END) AS taken FROM l3
"""
