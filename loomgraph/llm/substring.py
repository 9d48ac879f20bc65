"""Substring dedup by super-k-mer partitioning.

Method. A window is 50 consecutive words. The minimiser of a window is the least hash among its M-word grams. Consecutive
windows of one document that share their minimiser make a super-k-mer, which travels as one packed string, the windows'
words, to the minimiser's bucket; equal windows have equal minimisers and so meet there, where a sort brings them together
and tells in which documents each starts.

Before any text travels, minimisers alone are counted: one that occurs in a single document has no window that starts in
another, so its super-k-mers stay where they are. Super-k-mers have at most LONGEST windows, so long runs come in pieces.

A minimiser of more than HOT windows (of a passage that very many share, say) would make a large bucket. Its super-k-mers are
parted once more where a second minimiser changes, which makes its windows' buckets, and equal strings are one by an
aggregation with partial sums, with their least id: a passage that very many documents share goes to its bucket as often as it
has different surroundings. What the bucket finds for a string is then joined to each place where the string stands.

Windows in a bucket are sorted by 128-bit fingerprints, and windows taken for equal are then compared as strings; where a
fingerprint stands for several strings, its windows are parted by the strings.

Cases. Null or empty texts have no windows, as have those of fewer than 50 words. Rows with a null id are never compared
and keep all. Rows with the same id are one document: they don't remove each other's words. Whole texts are used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import CHUNK_BYTES, Scratch, Words, as_long, chunks, in_arrow, mix

WINDOW, M, HOT, LONGEST = 50, 8, 100_000, 4096


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


class Windows:
    """The windows of several texts, with the minimiser of each, and the runs that share one (super-k-mers)."""

    def __init__(self, w: Words, window: int):
        self.m = min(M, window)
        self.words, self.width = w, window
        ok = np.flatnonzero(w.inside(window))
        least = _least(w.grams(self.m), window - self.m + 1)[ok]
        self.start, self.least, self.doc = ok, least, w.doc[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (np.diff(ok) != 1) | (np.diff(self.doc) != 0) | (least[1:] != least[:-1])
        self.run, self.run_end = self.pieces(new)

    def pieces(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the runs that new marks the starts of, none longer than LONGEST."""
        first = np.flatnonzero(new)
        since = np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))
        first = np.flatnonzero(since % LONGEST == 0)
        return first, np.append(first[1:], len(new))

    def second(self) -> np.ndarray:
        """Another minimiser of each window."""
        return _least(self.words.grams(self.m, 3), self.width - self.m + 1)[self.start]


def _minimisers(batches, window: int):
    """(m, id, row, n): the minimisers of each row, with their windows."""
    for batch in batches:
        ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for first, buf, off in chunks(batch.column(1)):
            v = Windows(Words(buf, off, lower=False), window)
            _, at, of = np.unique(mix(v.least) ^ v.doc.astype(np.uint64), return_index=True, return_inverse=True)
            doc = first + v.doc[at]
            yield pa.record_batch({"m": pa.array(as_long(v.least[at])), "id": pa.array(ids[doc]), "row": pa.array(rows[doc]), "n": pa.array(np.bincount(of, minlength=len(at)).astype(np.int64))})


def _pack(batches, window: int):
    """From (id, text, row, minimisers shared with other documents, those of them that are hot): packed super-k-mers."""
    for batch in batches:
        ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for first, buf, off in chunks(batch.column(1)):
            w = Words(buf, off, lower=False)
            v = Windows(w, window)
            if not len(v.run):
                continue
            cold, hot = (_in(batch.column(col).slice(first, w.docs), v) for col in (3, 4))
            runs = [(*(x[cold[v.run]] for x in (v.run, v.run_end)), v.least, False)]
            if hot.any():
                second = v.second()
                new = np.zeros(len(hot), bool)
                new[v.run] = True
                new[1:] |= second[1:] != second[:-1]
                a, b = v.pieces(new)
                runs.append((a[hot[a]], b[hot[a]], mix(v.least ^ mix(second)), True))
            for a, b, key, is_hot in runs:
                if not len(a):
                    continue
                packed = [b" ".join(bytes(buf[x:y]).split()) for x, y in zip(w.start[v.start[a]], w.end[v.start[b - 1] + window - 1], strict=True)]
                doc = v.doc[a]
                yield pa.record_batch([
                    pa.array(as_long(key[a])), pa.array(np.full(len(a), is_hot)), pa.array(ids[first + doc]), pa.array(rows[first + doc]),
                    pa.array(v.start[a] - w.first[doc]), pa.array(packed, pa.binary()),
                ], names=["m", "hot", "id", "row", "at", "packed"])


def _in(lists: pa.Array, v: Windows) -> np.ndarray:
    """Whose minimiser is among those listed for the window's text."""
    lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    listed = mix(values) ^ np.repeat(np.arange(len(lens)), lens).astype(np.uint64)
    return np.isin(mix(v.least) ^ v.doc.astype(np.uint64), listed)


def _met(ids: np.ndarray, most: np.ndarray, packed: list[bytes], window: int):
    """(string, from, to, least): runs of windows, by the place of the first word and the end of the last in their string, that
    also start in a document with the id `least`, which is smaller than the largest of the string's own, for whole buckets.
    ids, most: the least and the largest id of the documents that hold each string."""
    off = np.concatenate(([0], np.cumsum([len(p) for p in packed]))).astype(np.int64)
    buf = np.frombuffer(b"".join(packed), np.uint8)
    w = Words(buf, off, lower=False)
    start = np.flatnonzero(w.inside(window))
    row = w.doc[start]
    h1, h2 = w.grams(window, 1)[start], w.grams(window, 2)[start]
    order = np.lexsort((ids[row], h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    group = np.flatnonzero(new)
    head = order[np.repeat(group, np.diff(np.append(group, len(order))))]  # the window of the smallest id in each group
    dup = np.flatnonzero(most[row[order]] > ids[row[head]])
    mine, first, least = start[order[dup]], start[head[dup]], ids[row[head[dup]]]
    text = buf.tobytes()
    same = np.array([text[a:b] == text[c:d] for a, b, c, d in zip(w.start[mine], w.end[mine + window - 1], w.start[first], w.end[first + window - 1], strict=True)], bool)
    if not same.all():  # other windows have the fingerprint too: those groups are parted by the windows themselves
        of = np.cumsum(new) - 1
        odd = np.unique(of[dup[~same]])
        rest = ~np.isin(of[dup], odd)
        mine, least, same = mine[rest], least[rest], same[rest]
        more: list[tuple[int, int]] = []
        for g in odd.tolist():
            firsts: dict[bytes, int] = {}
            for x in order[group[g] : group[g + 1] if g + 1 < len(group) else len(order)].tolist():  # by rising ids
                a = firsts.setdefault(text[w.start[start[x]] : w.end[start[x] + window - 1]], x)
                if most[row[x]] > ids[row[a]]:
                    more.append((start[x], ids[row[a]]))
        if more:
            mine, least = (np.append(y, np.array(z, y.dtype)) for y, z in zip((mine, least), zip(*more, strict=True), strict=True))
            same = np.append(same, np.ones(len(more), bool))
    mine, least = mine[same], least[same]
    by = np.argsort(mine)
    mine, least = mine[by], least[by]
    r = w.doc[mine]
    place = mine - w.first[r]
    cut = np.ones(len(mine), bool)
    cut[1:] = (np.diff(mine) != 1) | (np.diff(r) != 0) | (np.diff(least) != 0)
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(mine))[: len(a)] - 1
    return r[a], place[a], place[b] + window, least[a]


def _buckets(batches, window: int, limit: int = CHUNK_BYTES):
    """Over (m, least id, largest id, packed, ...) sorted by m: whole buckets together, as many as make up about `limit` bytes.
    Each run of windows found, with the other columns of its string."""
    held: list[pa.RecordBatch] = []

    def work(part: pa.Table):
        """part: whole buckets."""
        m = part["m"].to_numpy()
        size = np.cumsum(pc.binary_length(part["packed"]).to_numpy().astype(np.int64))
        i = 0
        while i < len(m):
            j = int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right"))
            j = int(np.searchsorted(m, m[min(max(j, i + 1), len(m)) - 1], "right"))
            x = part.slice(i, j - i)
            at, a, b, least = _met(x["id"].to_numpy(), x["most"].to_numpy(), x["packed"].to_pylist(), window)
            if len(at):
                rest = x.drop_columns(["m", "id", "most", "packed"]).take(pa.array(at)).combine_chunks()
                for c, y in (("from", a), ("to", b), ("least", least)):
                    rest = rest.append_column(c, pa.array(y.astype(np.int64)))
                yield from rest.to_batches()
            i = j

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            part = pa.Table.from_batches(held)
            m = part["m"].to_numpy()
            cut = int(np.searchsorted(m, m[-1]))  # the last bucket may go on
            if cut:
                yield from work(part.slice(0, cut))
                held = part.slice(cut).combine_chunks().to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def _row(id: str, text: str):
    """What rows that say the same have in common; rows of one id may differ in their texts."""
    return F.xxhash64(F.col(id).cast("long"), F.col(text))


def repeated(scratch: Scratch, docs: DataFrame, id: str, text: str, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id, row, ranges array<struct<from, to>>): ranges of words, from 0, that are to go from each row that has any."""
    d = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), _row(id, text).alias("row"))
    seen = scratch.table(d.transform(in_arrow, lambda b: _minimisers(b, window), "m long, id long, row long, n long"))
    shared = seen.groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("n").alias("n")).where("a < b").select("m", (F.col("n") > hot).alias("hot"))
    of_row = seen.join(shared, "m").groupBy("id", "row").agg(F.collect_set(F.when(~F.col("hot"), F.col("m"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("m"))).alias("hot"))
    d = d.join(of_row, ["id", "row"]).select("id", "text", "row", "cold", "hot")
    parts = scratch.table(d.transform(in_arrow, lambda b: _pack(b, window), "m long, hot boolean, id long, row long, at long, packed binary"))
    scratch.drop(seen)

    def met(strings: DataFrame, kept: str) -> DataFrame:
        own = strings.repartition("m").sortWithinPartitions("m")
        return own.transform(in_arrow, lambda b: _buckets(b, window), f"{kept}, `from` long, `to` long, least long")

    place = lambda c: (F.col("at") + F.col(c)).alias(c)
    one = parts.where("not hot").select("m", "id", F.col("id").alias("most"), "packed", F.col("id").alias("of"), "row", "at")
    ranges = met(one, "of long, row long, at long").select(F.col("of").alias("id"), "row", place("from"), place("to"))
    many = parts.where("hot").withColumn("string", F.unhex(F.md5("packed")))
    strings = many.groupBy("m", "packed").agg(F.min("id").alias("id"), F.max("id").alias("most"), F.first("string").alias("string"))
    found = met(strings.select("m", "id", "most", "packed", "string"), "string binary")
    more = many.select("string", "id", "row", "at").join(found, "string").where("least < id").select("id", "row", place("from"), place("to"))
    return ranges.union(more).groupBy("id", "row").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, digests: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed and kept, the words that stay joined by one space (with digests,
    kept_sha256 instead)."""
    scratch = Scratch(docs.sparkSession, "substring")
    gone = scratch.table(repeated(scratch, docs, id, text, window, hot))

    def run(batches):
        for batch in batches:
            n, out, kept = [], [], []
            for x, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (x or "").encode().split()
                stays = words
                if ranges:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [r["from"] for r in ranges], 1)
                    np.add.at(gone, [r["to"] for r in ranges], -1)
                    stays = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                joined = b" ".join(stays)
                n.append(len(words))
                out.append(len(words) - len(stays))
                kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", last])

    last = "kept_sha256" if digests else "kept"
    kind = docs.schema[id].dataType.simpleString()
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.when(F.col(id).isNotNull(), _row(id, text)).alias("row"))
    j = d.join(gone.withColumnRenamed("id", "__id"), (F.col("id").cast("long") == F.col("__id")) & (d.row == gone.row), "left").select("id", "text", "ranges")
    return j.transform(in_arrow, run, f"id {kind}, n_words long, n_removed long, {last} string").withColumnRenamed("id", id)


def op7(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
