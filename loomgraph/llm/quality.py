"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Method. A logistic model of style and word features gives each document's own probability of being good. Grouped
aggregation sums these over every path (host and section) and host. A host's rate is shrunk toward the global rate, a
path's toward its host's, each with a strength that the spread of the groups' rates gives (method of moments), so sparse
sites say little. A document's evidence and its path's posterior (without the document itself) are added as log odds.

A document is good when it is labelled quality 1 and not toxic. Fitted on at most SAMPLE labelled rows, chosen by a hash
of their id; everything else covers all documents. The model is a few hundred numbers.

Cases. Null text: empty, with features of zero. Null host or path: groups of their own. Null ids: scored, never a labelled
sample. Repeated rows: repeated results. Without labelled rows of both kinds nothing is known and all documents stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, Words, as_long, chunks, in_arrow

#: Labelled rows that the model is fitted on at most, words it may know, and site rows that are broadcast at most.
SAMPLE, WORDS, BROADCAST_SITES = 6000, 400, 200_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BETWEEN = ~_LETTER


def _class(*codes) -> np.ndarray:
    x = np.zeros(256, bool)
    for c in codes:
        x[c] = True
    return x


_CLASSES = [
    _class(slice(65, 91)), _class(slice(48, 58)), _class(slice(128, 256)), _class(32), _class(10), _class(ord("|")), _class(ord("!")),
    _class(*map(ord, "#$%&*@^~=+<>{}[]\\/_")), _class(*map(ord, ".,;:?'\"-()")),
]
STYLE = len(_CLASSES) + 5


def features(texts: pa.Array):
    """For consecutive rows: (first row, style features, (row, word hash) of each distinct word)."""
    for first, buf, off in chunks(texts):
        w = Words(buf, off, lower=True, between=_BETWEEN)
        size = np.maximum(np.diff(off), 1)
        x = np.zeros((w.docs, STYLE))
        for k, member in enumerate(_CLASSES):
            sums = np.concatenate(([0], np.cumsum(member[buf], dtype=np.int64)))
            x[:, k] = np.sqrt((sums[off[1:]] - sums[off[:-1]]) / size)
        n = np.maximum(w.count, 1)
        key = as_long(w.hash ^ (w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, at = np.unique(key, return_index=True)
        doc, word = w.doc[at], w.hash[at]
        k = len(_CLASSES)
        x[:, k] = np.log1p(w.count) / 10
        x[:, k + 1] = np.bincount(doc, minlength=w.docs) / n
        x[:, k + 2] = np.bincount(w.doc, w.end - w.start, w.docs) / n / 20
        x[:, k + 3] = np.log1p(w.count) / np.log(2 + np.bincount(doc, minlength=w.docs)) / 2
        x[:, k + 4] = w.count == 0
        yield first, x, doc, word


class Model:
    """Weights of the style features and of the known words, which are kept sorted by hash."""

    def __init__(self, mean, scale, style, words, weights, bias, prior):
        self.mean, self.scale, self.style, self.words, self.weights, self.bias, self.prior = mean, scale, style, words, weights, bias, prior

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for _, x, doc, word in features(texts):
            z = self.bias + ((x - self.mean) / self.scale) @ self.style
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
                hit = self.words[at] == word
                z += np.bincount(doc[hit], self.weights[at[hit]], len(x))
            out.append(np.clip(z, -12, 12))
        return np.concatenate(out)


def _fit(x: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def good(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, y): 1 where quality is 1 and toxic is not, for each labelled id once."""
    y = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)
    return labels.where(F.col(id).isNotNull() & F.col("quality").isNotNull()).groupBy(id).agg(F.min(y).alias("y"))


def train(docs: DataFrame, labelled: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` of the rows of labelled (id, y), which are chosen by hash."""
    n = labelled.count()
    part = labelled
    if n > sample:
        part = labelled.where(F.pmod(F.xxhash64(id), F.lit(1 << 20)) < int((1 << 20) * sample / n)).orderBy(F.xxhash64(id)).limit(sample)
    rows = docs.select(F.col(id), F.col(text).alias("text")).join(F.broadcast(part.select(id, "y")), id).select("text", "y")

    def run(batches):
        for batch in batches:
            for first, x, doc, word in features(batch.column(0)):
                ends = np.searchsorted(doc, np.arange(len(x) + 1)) if (np.diff(doc) >= 0).all() else None
                if ends is None:
                    order = np.argsort(doc, kind="stable")
                    doc, word = doc[order], word[order]
                    ends = np.searchsorted(doc, np.arange(len(x) + 1))
                yield pa.record_batch({
                    "y": batch.column(1).slice(first, len(x)),
                    "x": pa.array(list(x), pa.list_(pa.float64())),
                    "w": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_long(word))),
                })

    got = rows.transform(in_arrow, run, "y double, x array<double>, w array<long>").toArrow()
    y = np.asarray(got["y"], float)
    none = np.empty(0, np.uint64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(STYLE), np.ones(STYLE), np.zeros(STYLE), none, np.empty(0), 4.0, 0.98)
    x = np.array(got["x"].to_pylist())
    lists = got["w"].combine_chunks()
    word = lists.flatten().to_numpy().view(np.uint64)
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    # The words whose presence tells most: the deviation of the good documents among those with the word, in standard errors.
    u, at, c = np.unique(word, return_inverse=True, return_counts=True)
    m = y.mean()
    z = np.abs(np.bincount(at, y[doc]) - c * m) / np.sqrt(c * m * (1 - m))
    z[c < 5] = 0
    top = np.argsort(-z, kind="stable")[:WORDS]
    top = np.sort(top[z[top] > 4.0])
    place = np.full(len(u), -1)
    place[top] = range(len(top))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    full = np.zeros((len(y), STYLE + len(top) + 1))
    full[:, :STYLE] = (x - mean) / scale
    hit = place[at] >= 0
    full[doc[hit], STYLE + place[at[hit]]] = 1
    full[:, -1] = 1
    w = _fit(full, y, np.array([1.0] * STYLE + [0.3] * len(top) + [1e-6]))
    return Model(mean, scale, w[:STYLE], u[top], w[STYLE:-1], w[-1], float(m))


def _scored(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """docs' columns keep, and __z: the log odds of each document by itself."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(model.logits(batch.column(len(keep))))], names=[*keep, "__z"])

    d = docs.select(*keep, F.col(text).alias("__text"))
    return d.transform(in_arrow, run, d.drop("__text").schema.add("__z", "double"))


def _strength(n: str, rate: str, toward):
    """How many documents the prior is worth: from the spread of groups' rates about `toward` beyond that of chance."""
    spread = F.sum(F.col(n) * F.pow(F.col(rate) - toward, 2)) / F.sum(n)
    chance = F.sum(toward * (1 - toward)) / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-4))
    return F.greatest(F.avg(toward * (1 - toward)) / between - 1, F.lit(1.0))


def sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(host, path, n, s, prior, strength): documents and their summed probabilities by path, and what a path is shrunk to.

    Three aggregations, each over what the one before it left; sums are formed before anything is shuffled."""
    p = 1 / (1 + F.exp(-F.col("__z")))
    paths = scored.groupBy(F.col(host).alias("h"), F.col(path).alias("g")).agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    world = hosts.agg((F.sum("hs") / F.sum("hn")).alias("m"))
    spread = hosts.withColumn("rate", F.col("hs") / F.col("hn")).crossJoin(F.broadcast(world))  # world is one row
    world = spread.agg(F.first("m").alias("m"), _strength("hn", "rate", F.col("m")).alias("k"))
    hosts = hosts.crossJoin(F.broadcast(world)).withColumn("prior", (F.col("hs") + F.col("k") * F.col("m")) / (F.col("hn") + F.col("k")))
    j = paths.alias("p").join(hosts.alias("q"), F.col("p.h").eqNullSafe(F.col("q.h"))).select("p.h", "p.g", "n", "s", "prior", "m")
    k = j.withColumn("rate", F.col("s") / F.col("n")).agg(_strength("n", "rate", F.col("prior")).alias("strength"))
    return j.crossJoin(F.broadcast(k))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", cut: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """docs' columns id, host, path and carry, with p_doc (the document by itself), p_path (its path without it),
    p_quality and keep (p_quality >= cut). The text goes through Python twice and is never shuffled."""
    model = train(docs, good(labels, id), id, text)
    found = sites(_scored(docs, model, text, [host, path] if host != path else [host]), host, path)
    found = Scratch(docs.sparkSession, "quality").table(found)
    found = F.broadcast(found) if found.count() <= BROADCAST_SITES else found
    keep = list(dict.fromkeys([id, host, path, *(carry or [])]))
    d = _scored(docs, model, text, keep).alias("d").join(found.alias("s"), F.col(f"d.{host}").eqNullSafe(F.col("s.h")) & F.col(f"d.{path}").eqNullSafe(F.col("s.g")))
    p = 1 / (1 + F.exp(-F.col("__z")))
    rest = (F.col("s.s") - p + F.col("s.strength") * F.col("s.prior")) / (F.col("s.n") - 1 + F.col("s.strength"))
    odds = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    q = 1 / (1 + F.exp(-(F.col("__z") + odds(rest) - odds(F.col("s.m")))))
    return d.select(*[F.col(f"d.{c}").alias(c) for c in keep], p.alias("p_doc"), rest.alias("p_path"), q.alias("p_quality"), (q >= cut).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", cut: float = 0.5) -> DataFrame:
    """The rows of docs that classify() keeps, with docs' own columns, whatever their names."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    safe, labels = docs.toDF(*names.values()), labels.withColumnRenamed(id, names[id])
    found = classify(safe, labels, names[id], names[text], names[host], names[path], cut, carry=list(names.values()))
    return found.where("keep").select(*[F.col(n).alias(c) for c, n in names.items()])


def url_site(url) -> tuple:
    """(host, first section of the path) of a url column, for pages."""
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)), F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/[^/?#]*)", 1)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels)
