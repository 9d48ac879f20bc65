"""Embedding near-dedup by sorted projection passes.

Method. In each pass the vectors of a label are ordered lexicographically by concatenated hash bits, the signs of random
projections. A vector is compared with the next WINDOW in that order, and beyond them with all that agree with it in its first
bits, one bit for each doubling of the label beyond WINDOW vectors: such a run has about WINDOW vectors, and one of any size is
compared in full (in blocks where it has more than BUCKET), so nothing bounds a vector's partners. Tasks hold four
neighbouring runs, whose windows cross from run to run. Two vectors at the threshold differ in a bit with a probability that
depends on their angle alone, not on how the others lie, so the number of passes follows from the number of bits: a pair shares
a run in none of them with a probability of MISS at most. (Bits of vectors centred by their label would part tight labels
better, but near the centre no such bound holds.) Verified pairs of all passes are united to components; of each window, only as
many leave as join what it links.

Links are counted once more inside each component, all against all in blocks: groups of any number of near copies have all
their links, and only pairs that no chain of links connects can be missed. Vectors that are equal count once, with their
number. Nothing but counts leaves the blocks. Vectors so close together that the bits don't part them make long runs, whose
work grows with the square of their length.

Cases. Vectors that are null, zero or hold null or non-finite components, rows without a label, and rows whose id is null or no
whole number: linked with nothing, and kept. Labels of any type are compared as text. Vectors of different lengths have no
cosine: a label's vectors of each length are compared on their own. Repeated rows are equal vectors; with one id, they count
as links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, components, in_arrow
from loomgraph.llm.vectors import groups, matrix, stack, to_blobs, usable

WINDOW, BUCKET, MISS, BITS, BLOCK = 64, 2048, 0.0001, 62, 512
#: Bits more than a run's own are sorted by; bits fewer make four runs that a task holds together.
FINER, COARSER = 16, 2
THRESHOLD = 0.98


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in doubles, of vectors as they are."""
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def passes_for(bits: int, t: float) -> int:
    """So many that a pair at the threshold agrees in all bits of none of them with a probability of MISS at most."""
    agree = (1 - np.arccos(t) / np.pi) ** bits
    return 1 if bits == 0 else max(1, int(np.ceil(np.log(MISS) / np.log1p(-agree))))


def _keyed(batches, window: int, t: float):
    """Each vector once for each pass of its label, with the order there. Rows: id, label, v, number of the label's vectors of
    that length, length. Columns: pass, label, d, group (four runs), run, code (what is sorted by, first bit highest), id, v."""
    bits_of = lambda n: np.clip(np.ceil(np.log2(np.maximum(n, 1) / window)), 0, BITS - FINER).astype(np.int64)
    passes = np.array([passes_for(b, t) for b in range(BITS + 1)])
    planes: dict = {}
    for batch in batches:
        size = batch.column(4).to_numpy()
        for d in np.unique(size).tolist():
            part = batch.take(pa.array(np.flatnonzero(size == d)))
            x, bits = matrix(part.column(2), d), bits_of(part.column(3).to_numpy())
            blobs = to_blobs(x)
            for p in range(passes[bits].max()):
                if (p, d) not in planes:
                    planes[p, d] = np.random.default_rng([11, p]).standard_normal((d, BITS))
                own = np.flatnonzero(passes[bits] > p)
                most = int(bits[own].max()) + FINER
                code = np.zeros(len(own), np.int64)
                for positive in (x[own] @ planes[p, d][:, :most] > 0).T:
                    code = code << 1 | positive
                run = code >> (most - bits[own])
                group = code >> (most - np.maximum(bits[own] - COARSER, 0))
                at, same = pa.array(own), pa.array(np.full(len(own), p, np.int32))
                # rows of other labels in a batch may be longer by some bits: only the order within a label counts, and there
                # all rows have the label's own number
                code = code >> (most - bits[own] - FINER)
                yield pa.record_batch([same, part.column(1).take(at), part.column(4).take(at), pa.array(group), pa.array(run), pa.array(code), part.column(0).take(at), blobs.take(at)], names=["pass", "label", "d", "grp", "run", "code", "id", "v"])


class _Verified:
    """Vectors of one task's group, and which of them links join."""

    def __init__(self, x: np.ndarray, t: float):
        self.x, self.t = x, t
        self.u = x / np.sqrt((x * x).sum(1))[:, None]
        self.root = np.arange(len(x))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a with all of b: verifies, and unites what is linked."""
        near = self.u[a] @ self.u[b].T
        p, q = np.nonzero(near >= self.t - 1e-9)
        close = near[p, q] < self.t + 1e-9  # so near the threshold, the plain formula decides
        p, q = a[p], b[q]
        close[close] = _cosines(self.x[p[close]], self.x[q[close]]) < self.t
        p, q, root = p[~close], q[~close], self.root
        while len(p):
            r, s = root[p], root[q]
            p, q, r, s = (y[r != s] for y in (p, q, r, s))
            np.minimum.at(root, np.maximum(r, s), np.minimum(r, s))
            while (root[root] != root).any():
                root = root[root]
        self.root = root

    def links(self, ids: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(self.root != np.arange(len(ids)))
        return pa.record_batch([pa.array(ids[self.root[own]]), pa.array(ids[own])], names=["a", "b"])


def _windows(batches, window: int, t: float):
    """(a, b): links that join what the windows of each group link. Rows lie in the order of the pass."""
    for (_, _, d, _), g in groups(batches, 4):
        ids, run = g["id"].to_numpy(), g["run"].to_numpy()
        found = _Verified(stack(g["v"].to_pylist(), d), t)
        last = np.searchsorted(run, run, "right")  # where each vector's run ends
        for k in range(0, len(ids), window):
            own = np.arange(k, min(k + window, len(ids)))
            found.compare(own, np.arange(k, min(len(ids), max(own[-1] + 1 + window, last[own[-1]]))))
        yield found.links(ids)


def _links(batches, t: float):
    """(a, b): links that join all vectors of two blocks of a run that a chain of links among them joins."""
    for (_, _, d, _, i, j), g in groups(batches, 6):
        side, ids = g["side"].to_numpy(), g["id"].to_numpy()
        found = _Verified(stack(g["v"].to_pylist(), d), t)
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        for k in range(0, len(a), BLOCK):
            found.compare(a[k : k + BLOCK], b)
        yield found.links(ids)


def _recount(batches, t: float):
    """(id, n): links between the rows of two blocks of a component, each weighted with the other's number of copies."""
    for (_, i, j), g in groups(batches, 3):
        side, ids, n = (g[c].to_numpy() for c in ("side", "id", "copies"))
        x = matrix(g["v"].combine_chunks(), len(g["v"][0]))
        u = x / np.sqrt((x * x).sum(1))[:, None]
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        met = np.zeros(len(ids), np.int64)
        for k in range(0, len(a), BLOCK):
            c = a[k : k + BLOCK]
            near = u[c] @ u[b].T
            linked = near >= t
            close = np.argwhere(np.abs(near - t) < 1e-9)  # so near the threshold, the plain formula decides
            if len(close):
                linked[close[:, 0], close[:, 1]] = _cosines(x[c[close[:, 0]]], x[b[close[:, 1]]]) >= t
            linked &= ids[c][:, None] != ids[b][None, :]
            met[c] += linked @ n[b]
            if i != j:
                met[b] += n[c] @ linked
        yield pa.record_batch([pa.array(ids), pa.array(met)], names=["id", "n"])


def dedup(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, bucket: int = BUCKET) -> DataFrame:
    """One row per row of rows: id, n_links, component_id, kept."""
    scratch = Scratch(rows.sparkSession, "neardup")
    r = rows.select(F.col(id).alias("id"), F.col(id).try_cast("long").alias("n"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    ok = usable("v") & F.col("label").isNotNull() & F.col("n").isNotNull()
    fit, unfit = r.where(ok), r.where(~F.coalesce(ok, F.lit(False)))
    fit = fit.withColumn("key", F.struct(F.xxhash64("label", "v").alias("x"), F.xxhash64(F.reverse("v"), "label").alias("y")))
    classes = scratch.table(fit.groupBy("key").agg(F.min("n").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))

    sized = classes.select("id", "label", "v", F.size("v").alias("d"))
    many = sized.join(sized.groupBy("label", "d").agg(F.count("*").alias("n")), ["label", "d"]).select("id", "label", "v", "n", "d")
    keyed = scratch.table(many.transform(in_arrow, lambda b: _keyed(b, window, threshold), "pass int, label string, d int, grp long, run long, code long, id long, v binary"))
    where, group = ["pass", "label", "d", "run"], ["pass", "label", "d", "grp"]
    long = scratch.table(keyed.groupBy(*where).agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts")).where("parts > 1"))
    short = keyed.join(long, where, "left_anti").select(*group, "run", "code", "id", "v")
    short = short.repartition(*group).sortWithinPartitions(*group, "code", "id")
    links = short.transform(in_arrow, lambda b: _windows(b, window, threshold), "a long, b long")
    side = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    blocks = keyed.join(long, where).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select(*where, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "v")
    place = [*where, "i", "j"]
    blocks = blocks.repartition(*place).sortWithinPartitions(*place)
    links = scratch.table(links.union(blocks.transform(in_arrow, lambda b: _links(b, threshold), "a long, b long")))
    scratch.drop(keyed)
    groups_ = scratch.table(components(scratch, links))

    member = groups_.join(classes, groups_.node == classes.id).select("component", "id", "copies", "v")
    size = groups_.groupBy("component").agg(F.count("*").alias("size"))
    member = member.join(size, "component").withColumn("parts", F.ceil(F.col("size") / bucket).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    member = member.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "copies", "v")
    counted = member.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").transform(in_arrow, lambda b: _recount(b, threshold), "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    of = classes.select("key", "id", "copies").join(counted, "id", "left").join(groups_.withColumnRenamed("node", "id"), "id", "left")
    of = of.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = fit.select("id", "n", "key").join(of, "key").select("id", "n", "n_links", "component_id")
    alone = unfit.select("id", "n", F.lit(0).cast("long").alias("n_links"), F.col("n").alias("component_id"))
    kept = F.coalesce(F.col("n") == F.col("component_id"), F.lit(True))
    return linked.union(alone).select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
