"""Toxicity: a classifier that is regularised by counterfactuals.

Method. A logistic model says how likely a text is toxic, from which words it holds, which beginnings of longer words, and how
long it is. To the loss of the labelled documents comes a penalty on counterfactual sentences: each labelled sentence that
names a group of people is written again with another term of the same kind in its place, and the squared change of the log
odds, weighed by COUNTERFACTUAL, is added. So the model can't lower its loss by what it has against the mention of a group, and
neutral mentions stay neutral; what is left to it are words that insult whoever is named. The loss stays convex; Newton's
method finds its minimum.

Fitted on at most SAMPLE labelled documents, chosen by a hash of their id among those that may be learned from; of their words
the model knows at most FEATURES, those whose presence tells most. All documents are scored whole, in one pass without a
shuffle; language, source, ids and labels are no inputs of a score.

Cases. Null and empty texts hold no words and have the score of that. A null id is scored, not held out and has no label. Of
several labels of one id the toxic one counts; a null label is none. Repeated rows have the same score. Without labels of both
kinds all scores are the share of toxic ones, 0 if there is none. Further columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, Words, as_long, byte_hash, chunks, in_arrow, mix

#: Labelled documents that the model is fitted on at most, features it may know, the deviation (in standard errors) and the number of
#: documents from which a word is one, and the weight of the penalty.
SAMPLE, FEATURES, DEVIATION, SEEN, COUNTERFACTUAL = 20_000, 1500, 4.0, 3, 4.0
#: Bytes that make up the beginning of a longer word, and rows of the fit that are worked on at once.
BEGINNING, BLOCK = 6, 1024
#: Folds of the ids, the one that is held out, and the score from which a document is called toxic.
FOLDS, HELD_OUT, CUT = 3, 1, 0.7

#: Terms for groups of people that stand for one another, by kind. A parameter of train(); lower case, single words.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "migrants"),
    ("disabled", "blind", "deaf", "old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "atheisten"), ("ausländer", "einheimische", "flüchtlinge", "bürger"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"), ("immigrés", "étrangers", "réfugiés", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "ateos"), ("inmigrantes", "extranjeros", "refugiados", "ciudadanos"),
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BETWEEN = ~_LETTER
_SENTENCE = re.compile(r"[.!?\n]+")


def features(texts: pa.Array):
    """For consecutive rows: (first row, words of each row, hashes of the features that each row holds, sorted by row, with the
    row of each). A feature is a word, or the first BEGINNING bytes of a longer one."""
    for first, buf, off in chunks(texts):
        w = Words(buf, off, lower=True, between=_BETWEEN)
        long = np.flatnonzero(w.end - w.start > BEGINNING)
        begun = byte_hash(LOWER[buf], w.start[long], np.full(len(long), BEGINNING))
        h, doc = np.concatenate([w.hash, mix(begun ^ np.uint64(1))]), np.concatenate([w.doc, w.doc[long]])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield first, w.count, h[new], doc[new]


def _length(count: np.ndarray) -> np.ndarray:
    return np.log1p(count) / 10


class Model:
    """Weights of the known features, sorted by hash, of a text's length, and the bias."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, length: float, bias: float):
        self.known, self.weights, self.length, self.bias = known, weights, length, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for _, count, h, doc in features(texts):
            z = self.bias + self.length * _length(count)
            if len(self.known):
                at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                hit = self.known[at] == h
                z = z + np.bincount(doc[hit], self.weights[at[hit]], len(count))
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out)


def _swaps(text: str, kinds: dict[str, tuple[str, ...]], term: re.Pattern) -> list[tuple[str, str]]:
    """(sentence, the same with another term of the kind) for each mention in a text and each other term."""
    out = []
    for sentence in _SENTENCE.split(text) if term.search(text) else ():
        for m in term.finditer(sentence):
            own = m.group().lower()
            out += [(sentence, sentence[: m.start()] + other + sentence[m.end() :]) for other in kinds[own] if other != own]
    return out


def _pattern(groups: tuple[tuple[str, ...], ...]) -> tuple[dict[str, tuple[str, ...]], re.Pattern]:
    """The kind of each term (its first one), and what finds a term as a whole word."""
    kinds: dict[str, tuple[str, ...]] = {}
    for kind in groups:
        for t in kind:
            kinds.setdefault(t, kind)
    return kinds, re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(kinds, key=len, reverse=True))) + r")\b", re.IGNORECASE)


def fit(x: np.ndarray, y: np.ndarray, swapped: np.ndarray, weight: np.ndarray, ridge: np.ndarray, penalty: float = COUNTERFACTUAL, times: np.ndarray | None = None) -> np.ndarray:
    """The weights with the least loss: logistic loss of rows x with labels y (each `times` often), plus the ridge, plus penalty / 2
    times the weighted squares of the changes of log odds. swapped: for each counterfactual, the change of its features. Rows
    are taken BLOCK at a time, so that besides x no more than the square of the features is held."""
    w = np.zeros(x.shape[1])
    pull = np.diag(ridge)
    for i in range(0, len(swapped), BLOCK):
        s = swapped[i : i + BLOCK].astype(float)
        pull += penalty * (s.T * weight[i : i + BLOCK]) @ s
    times = np.ones(len(y)) if times is None else times
    for _ in range(50):
        slope, bend = -pull @ w, pull.copy()
        for i in range(0, len(x), BLOCK):
            part, n = x[i : i + BLOCK].astype(float), times[i : i + BLOCK]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (n * (y[i : i + BLOCK] - p))
            bend += (part.T * (n * p * (1 - p))) @ part
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labelled(labels: DataFrame, id: str, folds: int, held_out: int) -> DataFrame:
    """(id, y): the labels that may be learned from, one for each id."""
    may = F.col(id).isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col(id).cast("string")) % folds != held_out)
    return labels.where(may).groupBy(id).agg(F.max("toxic").cast("double").alias("y"))


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE,
    groups: tuple[tuple[str, ...], ...] = GROUPS, penalty: float = COUNTERFACTUAL,
) -> Model:
    """A model from at most `sample` of the labelled rows (id, toxic), but for those whose crc32(id as text) mod folds is held_out."""
    known = _labelled(labels, id, folds, held_out)
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(id), F.lit(1 << 20)) < int((1 << 20) * sample / n)).orderBy(F.xxhash64(id)).limit(sample)
    rows = docs.select(F.col(id), F.col(text).alias("text")).join(F.broadcast(known), id).select("text", "y")

    def seen(batches):
        """(feature, documents that hold it, toxic ones among them)."""
        for batch in batches:
            for first, count, h, doc in features(batch.column(0)):
                y = batch.column(1).slice(first, len(count)).to_numpy()
                u, at, c = np.unique(h, return_inverse=True, return_counts=True)
                yield pa.record_batch({"h": pa.array(as_long(u)), "n": pa.array(c.astype(np.int64)), "t": pa.array(np.bincount(at, y[doc], len(u)))})

    share, total = rows.agg(F.avg("y"), F.count("*")).first()
    if not total or share in (0.0, 1.0):
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0, 40.0 if share else -40.0)
    z = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    told = rows.select("text", "y").transform(in_arrow, seen, "h long, n long, t double").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    best = told.where(F.col("n") >= SEEN).withColumn("z", z).where(F.col("z") > DEVIATION).orderBy(F.desc("z"), "h").limit(FEATURES).toArrow()  # at most FEATURES rows
    words = np.sort(best["h"].to_numpy().view(np.uint64))
    kinds, term = _pattern(groups)

    def placed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
        return at, words[at] == h if len(words) else np.zeros(len(h), bool)

    def design(batches):
        """A row for each document: label, length, places of the features it holds; and one for each counterfactual that changes any:
        the places that go and those that come."""
        for batch in batches:
            texts = batch.column(0)
            for first, count, h, doc in features(texts):
                at, hit = placed(h)
                ends = np.searchsorted(doc[hit], np.arange(len(count) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit].astype(np.int32)))
                part = batch.column(1).slice(first, len(count))
                yield pa.record_batch([part, pa.array(_length(count)), lists, pa.nulls(len(count), pa.list_(pa.int32()))], names=["y", "length", "has", "gets"])
            swaps = [s for x in texts.to_pylist() for s in _swaps(x or "", kinds, term)]
            for i in range(0, len(swaps), 4096):
                sides = []
                for side in zip(*swaps[i : i + 4096], strict=True):
                    held: list[set[int]] = [set() for _ in side]
                    for first, _, h, doc in features(pa.array(side, pa.string())):
                        at, hit = placed(h)
                        for d, k in zip((first + doc[hit]).tolist(), at[hit].tolist(), strict=True):
                            held[d].add(k)
                    sides.append(held)
                change = [(sorted(a - b), sorted(b - a)) for a, b in zip(*sides, strict=True) if a != b]
                if change:
                    yield pa.record_batch([pa.nulls(len(change), pa.float64()), pa.nulls(len(change), pa.float64()), *(pa.array([c[k] for c in change], pa.list_(pa.int32())) for k in (0, 1))], names=["y", "length", "has", "gets"])

    made = rows.select("text", "y").transform(in_arrow, design, "y double, length double, has array<int>, gets array<int>")
    made = made.groupBy("y", "length", "has", "gets").agg(F.count("*").alias("n")).toArrow()  # documents of the sample, and pairs of terms
    y, n = made["y"].to_numpy(), made["n"].to_numpy().astype(float)
    doc = ~np.isnan(y)
    full = np.zeros((len(y), len(words) + 2), np.float32)
    full[:, -2], full[:, -1] = np.where(doc, made["length"].to_numpy(), 0), doc
    for c, one in (("has", np.where(doc, 1, -1)), ("gets", np.ones(len(y)))):
        lists = made[c].combine_chunks()
        row = np.repeat(np.arange(len(y)), lists.value_lengths().fill_null(0).to_numpy())
        full[row, lists.flatten().to_numpy()] = one[row]
    ridge = np.array([0.05] * len(words) + [0.1, 1e-6])
    w = fit(full[doc], y[doc], full[~doc], n[~doc], ridge, penalty, n[doc])
    return Model(words, w[:-2], w[-2], w[-1])


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, cut: float = CUT, model: Model | None = None
) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1) and predicted (1 if score >= cut)."""
    model = model or train(docs, labels, id, text, folds, held_out)

    def run(batches):
        for batch in batches:
            s = model.scores(batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id).cast("string")) % folds == held_out, F.lit(False))
    d = docs.select(F.col(id).alias("id"), held.alias("held_out"), F.col(text).alias("text"))
    return d.transform(in_arrow, run, d.select("id", "held_out").schema.add("score", "double").add("predicted", "integer")).withColumnRenamed("id", id)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
