"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Method. Coarse centroids and the codebooks of the residuals are fitted on a bounded sample. Every row is put into the cell
of its nearest centroid and its residual is coded by SUBSPACES codebooks of 256 entries. A query looks into the cells with
the largest inner products; asymmetric distance tables (the query against each codebook entry) score their rows. The SHORT
best of each block, and those whose score comes within the codes' error of the k-th of these, are ranked anew by exact inner
products of the original vectors.

How many cells a query looks into, and the error of the codes, are measured by brute force: TRIED of the queries against all
rows. So many cells that FOUND of these queries' neighbours lie in them, and an error that CODED of them don't exceed. A sample
of the rows would not tell: long vectors are few, near to many queries, and in cells and codes that were fitted without them.
Vectors without structure have their neighbours anywhere, which takes most cells; where vectors cluster, few do.
A query goes on to further cells until those that it looked into hold k other ids, or there are no more.

Cells are laid out in blocks of at most BLOCK rows: small cells together, a cell of more rows (copies of one vector, say)
in several blocks by a hash of the id. Each block meets the queries that probe one of its cells; queries stream past it.
Vectors of different lengths have no inner product: each length is searched on its own.

Cases. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Repeated ids:
one query each (with the least of their vectors), never their own neighbour, and one neighbour each (with the best of their
scores). Ties go to the smaller id. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, in_arrow
from loomgraph.llm.vectors import groups, matrix, stack, to_blobs, usable

SAMPLE, CELLS, SUBSPACES, ROUNDS = 16_384, 1024, 16, 6
FOUND, BLOCK, SHORT, STREAM = 0.97, 4096, 256, 128
TRIED, CODED, PAIRS = 256, 0.995, 1 << 16


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), 1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Centroids, and the codebooks of the residuals' parts. Its size is bounded: CELLS and 256 vectors of d numbers."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.cells = max(1, min(CELLS, int(4 * rows**0.5), len(sample) // 8 or 1))
        self.centroids = _kmeans(sample, self.cells, ROUNDS, rng)
        left = sample - self.centroids[self.cell(sample)]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.books = [_kmeans(left[:, a:b], 256, ROUNDS, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.counts = np.zeros(self.cells, np.int64)  # rows of each cell, once all rows are put into theirs
        self.enough, self.probed, self.error = 0, self.cells, 0.0  # error: of scores by codes, for a query of length 1

    def places(self, q: np.ndarray) -> np.ndarray:
        """Of each cell, its place in the order in which each query looks into cells."""
        return np.argsort(np.argsort(-(q @ self.centroids.T), 1, kind="stable"), 1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids**2).sum(1) - 2 * (x @ self.centroids.T), 1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = x - self.centroids[cell]
        return np.stack([np.argmin((b * b).sum(1) - 2 * (left[:, i:j] @ b.T), 1) for b, i, j in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray) -> np.ndarray:
        """For each query, which cells it looks into."""
        near = q @ self.centroids.T
        order = np.argsort(-near, 1, kind="stable")
        held = self.counts[order]
        wanted = (np.cumsum(held, 1) - held < self.enough) | (np.arange(self.cells) < self.probed)
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, order, wanted, 1)
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, i:j] @ b.T for b, i, j in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]

    def scores(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """By codes, of each query and row."""
        score = (q @ self.centroids.T)[:, cell].astype(np.float32)
        for s, table in enumerate(self.tables(q)):
            score += table.astype(np.float32)[:, codes[:, s]]
        return score


def fit(rows: DataFrame, d: int, n: int) -> Index:
    """rows: (id, v). The sample has the SAMPLE smallest hashes of ids."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    return Index(matrix(got["v"].combine_chunks(), d), n)


def _measure(index: Index, coded: DataFrame, queries: DataFrame, d: int, k: int) -> None:
    """Sets index.probed and index.error by the k nearest among all rows of TRIED of queries(id, v)."""
    got = queries.orderBy(F.xxhash64("id"), "id").limit(TRIED).toArrow()
    if not got.num_rows:
        return
    own, q = got["id"].to_numpy(), matrix(got["v"].combine_chunks(), d)
    place, length = index.places(q), np.sqrt((q * q).sum(1))

    def nearest(batches):
        held = None  # (query, id, score, place, error) of the best so far
        for batch in batches:
            ids, cell, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            x, codes = stack(batch.column(3).to_pylist(), d), np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)
            for a in range(0, len(ids), BLOCK):
                at = slice(a, a + BLOCK)
                score = q @ x[at].T
                wrong = (score - index.scores(q, cell[at], codes[at])) / length[:, None]
                score[own[:, None] == ids[at][None, :]] = -np.inf
                top = np.argpartition(-score, min(k, score.shape[1]) - 1, 1)[:, :k]
                who = np.repeat(np.arange(len(q)), top.shape[1])
                top = top.ravel()
                new = [who, ids[at][top], score[who, top], place[who, cell[at][top]], wrong[who, top]]
                new = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
                order = np.lexsort((-new[2], new[0]))
                first = np.searchsorted(new[0][order], np.arange(len(q)))
                order = order[(np.arange(len(order)) - first[new[0][order]] < k) & np.isfinite(new[2][order])]
                held = [c[order] for c in new]
        if held is not None:
            yield pa.record_batch([pa.array(c) for c in held], names=["query", "id", "score", "place", "error"])

    each = coded.transform(in_arrow, nearest, "query long, id long, score double, place long, error double")
    each = each.groupBy("query", "id").agg(F.max(F.struct("score", "place", "error")).alias("x")).select("query", "id", "x.*")
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    found = best.select("place", "error").toArrow()  # TRIED times k rows at most
    if found.num_rows:
        index.probed = int(np.quantile(found["place"].to_numpy(), FOUND, method="higher")) + 1
        index.error = max(0.0, float(np.quantile(found["error"].to_numpy(), CODED, method="higher")))


def _layout(counts: dict[int, int], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell."""
    first, several = np.zeros(cells, np.int64), np.ones(cells, np.int64)
    block, room = 0, BLOCK
    for c in range(cells):
        n = counts.get(c, 0)
        if n > BLOCK:
            block += room < BLOCK
            several[c] = -(-n // (BLOCK // 2))
            first[c] = block
            block += several[c]
            room = BLOCK
        else:
            if n > room:
                block, room = block + 1, BLOCK
            first[c] = block
            room -= n
    return first, several


_FOUND = "query_id long, rank int, vec_id long, score double"


def search(rows: DataFrame, query, id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which the column query is true."""
    scratch = Scratch(rows.sparkSession, "ann")
    r = rows.where(F.col(id).isNotNull() & usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), query.alias("q"))
    out = rows.sparkSession.createDataFrame([], _FOUND)
    for d, n, ids in r.groupBy(F.size("v").alias("d")).agg(F.count("*"), F.countDistinct("id")).orderBy("d").collect():  # a row for each length
        out = out.union(_search(scratch, r.where(F.size("v") == d), d, n, n - ids, k))
    return out


def _search(scratch: Scratch, r: DataFrame, d: int, n: int, repeated: int, k: int) -> DataFrame:
    """Among r(id, v, q), n rows with vectors of d components, of which so many repeat an id."""
    index = fit(r, d, n)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), d)
                cell = index.cell(x)
                yield pa.record_batch([batch.column(0), pa.array(cell), pa.array([c.tobytes() for c in index.codes(x, cell)], pa.binary()), to_blobs(x)], names=["id", "cell", "codes", "v"])

    coded = scratch.table(r.select("id", "v").transform(in_arrow, assign, "id long, cell long, codes binary, v binary"))
    counts = {x.cell: x["count"] for x in coded.groupBy("cell").count().collect()}  # CELLS rows at most
    for c, rows in counts.items():
        index.counts[c] = rows
    index.enough = k + 1 + repeated  # rows, with the query's own and those of repeated ids
    queries = r.where("q").groupBy("id").agg(F.min("v").alias("v"))
    _measure(index, coded, queries, d, k)
    first, several = _layout(counts, index.cells)
    blocks = int((first + several).max())

    def place(batches):
        for batch in batches:
            cell = batch.column(1).to_numpy()
            ids = batch.column(0).to_numpy()
            block = first[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % several[cell]
            yield pa.record_batch([pa.array(block), pa.array(np.zeros(len(ids), np.int32)), *batch.columns], names=["block", "kind", "id", "cell", "codes", "v"])

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), d)
            ids = batch.column(0).to_numpy()
            for a in range(0, len(x), 512):
                probes = index.probes(x[a : a + 512])
                to = np.zeros((len(probes), blocks), bool)
                for c in range(index.cells):
                    to[:, first[c] : first[c] + several[c]] |= probes[:, [c]]
                i, b = np.nonzero(to)
                blobs = to_blobs(x[a : a + 512])
                none = pa.nulls(len(i), pa.int64())
                yield pa.record_batch([pa.array(b), pa.array(np.ones(len(i), np.int32)), pa.array(ids[a + i]), none, pa.nulls(len(i), pa.binary()), blobs.take(pa.array(i))], names=["block", "kind", "id", "cell", "codes", "v"])

    shape = "block long, kind int, id long, cell long, codes binary, v binary"
    both = coded.transform(in_arrow, place, shape).union(queries.transform(in_arrow, ask, shape))
    both = both.repartition(min(blocks, 4096), "block").sortWithinPartitions("block", "kind", "id")

    def rank(batches):
        base = None
        for (_, kind), t in _streamed(batches):
            if kind == 0:
                base = (t["id"].to_numpy(), t["cell"].to_numpy(), np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1), stack(t["v"].to_pylist(), d)) if t.num_rows else None
            elif base is not None:
                ids, x = t["id"].to_numpy(), stack(t["v"].to_pylist(), d)
                for a in range(0, len(x), STREAM):
                    got = _nearest(index, ids[a : a + STREAM], x[a : a + STREAM], *base, k)
                    if got:
                        yield pa.record_batch([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

    near = both.transform(in_arrow, rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _streamed(batches):
    """The base of each block as one table; its queries as they come, some at a time. Block after block."""
    block, base = None, []
    for batch in batches:
        for (b, kind), t in groups([batch], 2):
            if b != block:
                block, base = b, []
                yield (b, 0), t.slice(0, 0)  # forgets the block before
            if kind == 0:
                base.append(t)
            else:
                if base:
                    yield (b, 0), pa.concat_tables(base)
                    base = []
                yield (b, 1), t


def _nearest(index: Index, qid, q, ids, cell, codes, x, k: int):
    """The k best of a block for each of some queries: listed by tables, ordered by exact inner products."""
    score = index.scores(q, cell, codes)
    score[~index.probes(q)[:, cell]] = -np.inf
    score[qid[:, None] == ids[None, :]] = -np.inf
    listed = SHORT + len(ids) - len(np.unique(ids))
    kept = k + listed - SHORT
    short = np.argsort(-score, 1, kind="stable")[:, :listed]  # rows lie by id, so ties keep the smaller
    exact = (x[short] * q[:, None, :]).sum(2)
    exact[~np.isfinite(np.take_along_axis(score, short, 1))] = -np.inf
    least = -np.partition(-exact, kept - 1, 1)[:, kept - 1] if exact.shape[1] >= kept else np.full(len(q), -np.inf)
    further = np.isfinite(score) & (score >= (least - index.error * np.sqrt((q * q).sum(1)))[:, None])
    np.put_along_axis(further, short, False, 1)
    who, row = np.nonzero(further)
    more = [(x[row[a : a + PAIRS]] * q[who[a : a + PAIRS]]).sum(1) for a in range(0, len(row), PAIRS)]
    who, row, exact = np.append(np.repeat(np.arange(len(q)), short.shape[1]), who), np.append(short.ravel(), row), np.concatenate([exact.ravel(), *more])
    order = np.lexsort((ids[row], -exact, who))
    who, row, exact = who[order], row[order], exact[order]
    ok = (np.arange(len(who)) - np.searchsorted(who, np.arange(len(q)))[who] < kept) & np.isfinite(exact)
    return qid[who[ok]], ids[row[ok]], exact[ok]


def op5(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, F.col("vec_id") % 20 == 0)
