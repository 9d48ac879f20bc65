"""LM scoring by deleted interpolation.

Method. Maximum-likelihood estimates of bigrams, unigrams and a uniform distribution are mixed; the mixture weights depend
on how often the context occurred in training (buckets of powers of two) and are learned by expectation-maximisation on
held-out counts: a second hash sets one in FIT training documents aside, whose events are measured by the counts of the other
training documents. Scores then use the counts of all training documents. Nothing is learned from the documents that the
contract holds out (crc32 mod folds = 0). Rates are rounded to an eighth of a doubling in the fit, and only there. The model knows every word of the training texts, the end of a text (which is also the
context of its first word) and one unknown word, so the probabilities of all texts sum to at most one.

What is gathered. Word counts over all training texts; bigram counts over all of them, of any words; held-out counts over
all held-out texts. The counts of the VOCABULARY most frequent words and of the pairs among the HOT most frequent of them
are only a cache that is sent to every task; results don't depend on it. All else is looked up where it is counted:
occurrences travel, packed, to a part of the key space, which counts the training ones and returns one sum for each
document. A pair of cached words goes by the pair, any other by the hash of a word that isn't cached: the first if it
isn't, else the second. So the part of a word outside the cache sees each of its occurrences as a context, which gives its
count. Where neither word is cached, the count of the second is joined from the word counts to the part of the first. No
pair outside the HOT words can be more frequent than the first word after them, and words outside the cache are rarer
still, so no part is made large by one key.

Cases. Null or empty text: one token, the end. Null id: scored, and not learned from. Repeated rows: learned from as often
as they occur, each scored. With no training text, everything is as likely as in the uniform distribution.
"""

from __future__ import annotations

import contextlib
import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, Words, as_long, chunks, in_arrow, mix

VOCABULARY, HOT, BUCKETS = 65_000, 512, 40
#: One in so many training documents, by a hash of id and text, has its events explained by the others when weights are learned.
FIT = 10
#: Occurrences that one part of the key space counts, on average, and that a task gathers before it sends them.
PART, GATHERED = 3_000_000, 2_000_000
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text among the words' hashes


def _sequences(texts: pa.Array):
    """(first row, hash of each token with an end after each text, index of its text) of consecutive rows."""
    for first, buf, off in chunks(texts):
        w = Words(buf, off, lower=True)
        ends = w.first[1:] + np.arange(w.docs)
        tokens = np.empty(len(w.hash) + w.docs, np.uint64)
        doc = np.repeat(np.arange(w.docs), w.count + 1)
        words = np.ones(len(tokens), bool)
        words[ends] = False
        tokens[words], tokens[ends] = w.hash, END
        yield first, tokens, doc


def _flat(batch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def _count_words(batches):
    """(h, c, f): counts of tokens, and those of them in documents set aside, merged over the whole task as far as memory
    allows. Batches: text, whether it is set aside."""
    held, size = [], 0

    def merged():
        h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return h, *(np.bincount(at, np.concatenate([x[i] for x in held]), len(h)).astype(np.int64) for i in (1, 2))

    def out(h, c, f):
        return pa.record_batch({"h": pa.array(as_long(h)), "c": pa.array(c), "f": pa.array(f)})

    for batch in batches:
        aside = _flat(batch, 1)
        for first, tokens, doc in _sequences(batch.column(0)):
            h, at, c = np.unique(tokens, return_inverse=True, return_counts=True)
            held.append((h, c, np.bincount(at, aside[first + doc], len(h))))
            size += len(h)
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*merged())


class Classes:
    """The cached words: their hashes sorted, with ids by rank. Ids: 0.. by falling count, then one that says not cached."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.order = order = np.lexsort((hashes, -counts))
        hashes, self.counts = hashes[order], counts[order]
        by = np.argsort(hashes)
        self.sorted, self.id = hashes[by], by.astype(np.uint32)
        self.other = len(hashes)
        self.total, self.distinct = total, distinct
        self.end = int(self.of(np.array([END]))[0])
        self.uniform = 1 / (max(1, distinct) + 1)  # all words, the end, and one unknown word

    def without(self, counts: np.ndarray, total: int) -> Classes:
        """The same words with the counts that are left without the documents set aside. counts: theirs, by id."""
        left = copy.copy(self)
        left.counts, left.total = self.counts - counts, self.total - total
        return left

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return np.where(self.sorted[at] == tokens, self.id[at], np.uint32(self.other))

    def pairs(self, cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """context and class of each token, in 32 bits."""
        before = np.empty_like(cls)
        before[1:] = cls[:-1]
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        before[new] = self.end
        return before << np.uint32(16) | cls

    def bucket(self, context: np.ndarray) -> np.ndarray:
        """Of counts of contexts: 0 for an unseen one, else 1 + the power of two below its count."""
        return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)

    def rates(self, count: np.ndarray, context: np.ndarray, word: np.ndarray):
        """Of the counts of pairs, of their contexts (each token is followed by one, and an end precedes each text, so
        contexts occur as tokens do) and of their words."""
        return self.bucket(context), count / np.maximum(1, context), word / max(1, self.total)

    def smooth(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _hot_pairs(batches, k: Classes):
    """(cell, c, f): counts of the pairs of HOT classes in training texts, and those in documents set aside: two tables of HOT
    squared numbers for each task."""
    sums = np.zeros((2, HOT * HOT), np.int64)
    for batch in batches:
        aside = _flat(batch, 1)
        for first, tokens, doc in _sequences(batch.column(0)):
            pair = k.pairs(k.of(tokens), doc)
            a, b = pair >> np.uint32(16), pair & np.uint32(0xFFFF)
            hot = (a < HOT) & (b < HOT) & (a != k.other) & (b != k.other)
            cell = a[hot].astype(np.int64) * HOT + b[hot]
            sums[0] += np.bincount(cell, minlength=HOT * HOT)
            sums[1] += np.bincount(cell[aside[first + doc[hot]]], minlength=HOT * HOT)
    cell = np.flatnonzero(sums[0])
    yield pa.record_batch({"cell": pa.array(cell.astype(np.int32)), "c": pa.array(sums[0][cell]), "f": pa.array(sums[1][cell])})


_STEPS = 8  # to a doubling, when rates are put into classes for expectation-maximisation


def _grades(b, f2, f1, uniform):
    """Events of documents set aside with like rates, counted together."""
    with np.errstate(divide="ignore"):
        q = [np.where(f > 0, np.clip(np.round(np.log2(f / uniform) * _STEPS), -400, 400), -500).astype(np.int64) for f in (f2, f1)]
    return np.unique((b * 1000 + q[0] + 500) * 1000 + q[1] + 500, return_counts=True)


def learn(grades: np.ndarray, count: np.ndarray, uniform: float) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform by expectation-maximisation; a bucket without such events
    has the weights of all events together."""
    b = grades // 1_000_000
    q = np.stack([grades // 1000 % 1000 - 500, grades % 1000 - 500], 1)
    f = np.concatenate([np.where(q <= -500, 0.0, uniform * 2.0 ** (q / _STEPS)), np.full((len(q), 1), uniform)], 1)
    f[b == 0, 0] = 0

    def em(part):
        w = np.full(3, 1 / 3)
        if part.any():
            for _ in range(60):
                share = f[part] * w
                share *= (count[part] / share.sum(1))[:, None]
                w = share.sum(0) / share.sum()
        w = np.maximum(w, 1e-7)
        return w / w.sum()

    pooled = em(b > 0) if (b > 0).any() else np.array([0.0, 0.5, 0.5])
    out = np.tile(pooled, (BUCKETS, 1))
    out[0] = em(b == 0) * [0, 1, 1] if (b == 0).any() else [0, 0.5, 0.5]
    out[0] /= out[0].sum()
    for x in range(1, BUCKETS):
        if (b == x).any():
            out[x] = em(b == x)
    return out


#: What a blob holds: counts of words that follow; pairs whose first word isn't cached, whose words both aren't, whose second
#: isn't; pairs of cached words that aren't hot.
FOLLOW, FIRST, BOTH, SECOND, CACHED = range(5)
_BLOBS = "part int, kind int, sender long, rows binary, train binary, counts binary, keys binary, others binary"
_NAMES = [c.split()[0] for c in _BLOBS.split(", ")]
_OTHERS = {FIRST: np.uint16, BOTH: np.uint64, SECOND: np.uint16, CACHED: np.uint16}


def _blob(part: int, kind: int, sender: int, *body: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([sender], pa.int64()), *(pa.array([x], pa.binary()) for x in body)], names=_NAMES)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(key.astype(np.uint64)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _classed(tokens: np.ndarray, doc: np.ndarray, k: Classes):
    """Ids of each token's context and of the token, and which of the two aren't cached."""
    pair = k.pairs(k.of(tokens), doc)
    a, b = pair >> np.uint32(16), pair & np.uint32(0xFFFF)
    return pair, a, b, a == k.other, b == k.other


def _follow(batches, k: Classes, parts: int):
    """(part, word): words outside the cache that follow one, with that one's part."""
    for batch in batches:
        for _, tokens, doc in _sequences(batch.column(0)):
            _, _, _, ra, rb = _classed(tokens, doc, k)
            at = np.flatnonzero(ra & rb)
            got = np.unique(np.stack([_part(tokens[at - 1], parts), as_long(tokens[at])], 1), axis=0)
            yield pa.record_batch({"part": pa.array(got[:, 0].astype(np.int32)), "h": pa.array(got[:, 1])})


def _follow_blobs(batches):
    """Batches: part, word, its count."""
    for batch in batches:
        part, h, c = (_flat(batch, i) for i in range(3))
        for p in np.unique(part):
            yield _blob(p, FOLLOW, 0, b"", b"", c[part == p].tobytes(), h[part == p].tobytes(), b"")


def _send(batches, k: Classes, parts: int):
    """Packs occurrences that are looked up elsewhere, for each part and kind: documents (row, in training), how many each
    has, and for each the key that decides the part, and the other word."""
    held: list = []
    size = 0

    def flush():
        row, train = np.concatenate([h["row"] for h in held]), np.concatenate([h["train"] for h in held])
        before = np.cumsum([0, *(len(h["row"]) for h in held)])
        for kind, other_type in _OTHERS.items():
            doc = np.concatenate([h[kind][0] + n for h, n in zip(held, before, strict=False)])
            key = np.concatenate([h[kind][1] for h in held])
            other = np.zeros(len(key), np.uint8) if kind == CACHED else np.concatenate([h[kind][2] for h in held])
            part = _part(key, parts)
            order = np.argsort(part.astype(np.int32), kind="stable")
            doc, key, other, part = doc[order], key[order], other[order].astype(other_type), part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = ends[p], ends[p + 1]
                if a == b:
                    continue
                own, n = np.unique(doc[a:b], return_counts=True)
                yield _blob(p, kind, int(row[0]), row[own].tobytes(), train[own].tobytes(), n.astype(np.int32).tobytes(), key[a:b].tobytes(), b"" if kind == CACHED else other[a:b].tobytes())

    for batch in batches:
        rows, train = _flat(batch, 1), _flat(batch, 2)
        for first, tokens, doc in _sequences(batch.column(0)):
            docs = int(doc[-1]) + 1
            pair, a, b, ra, rb = _classed(tokens, doc, k)
            one, both, two, cached = (np.flatnonzero(x) for x in (ra & ~rb, ra & rb, rb & ~ra, ~ra & ~rb & ((a >= HOT) | (b >= HOT))))
            held.append({
                "row": rows[first : first + docs], "train": train[first : first + docs],
                FIRST: (doc[one], tokens[one - 1], b[one]), BOTH: (doc[both], tokens[both - 1], tokens[both]),
                SECOND: (doc[two], tokens[two], a[two]), CACHED: (doc[cached], pair[cached], None),
            })
            size += len(pair)
            if size >= GATHERED:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _by_part(batches):
    """Rows that agree in part, CACHED apart from the other kinds, of a task's rows sorted by part and kind."""
    now, held = None, []
    for batch in batches:
        for part, kind, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, kind == CACHED) != now:
                if held:
                    yield held
                now, held = (part, kind == CACHED), []
            held.append((kind, *body))
    if held:
        yield held


def _counted(key, doc, train):
    _, at = np.unique(key, return_inverse=True)
    return np.bincount(at, train[doc])[at]


def _looked_up(part: list, k: Classes):
    """(blobs, rows, in training, index of each occurrence's row, counts of the pair, its context and its word, whether the
    context is outside the cache) for each kind."""

    def opened(kind, key_type=np.uint64):
        blobs = [x for x in part if x[0] == kind]
        cat = lambda i, t: np.frombuffer(b"".join(x[i] for x in blobs), t)
        rows = cat(2, np.int64)
        return (blobs, rows, cat(3, bool), np.repeat(np.arange(len(rows)), cat(4, np.int32))), cat(5, key_type), cat(6, _OTHERS[kind])

    if part[0][0] == CACHED:
        of, pair, _ = opened(CACHED, np.uint32)
        yield *of, _counted(pair, of[3], of[2]), k.counts[pair >> np.uint32(16)], k.counts[pair & np.uint32(0xFFFF)], False
        return
    (one, a1, b1), (both, a2, b2), (two, b3, a3) = opened(FIRST), opened(BOTH), opened(SECOND)
    word, at = np.unique(np.concatenate([a1, a2]), return_inverse=True)  # each occurrence of the part's words, as a context
    count = np.bincount(at, np.concatenate([one[2][one[3]], both[2][both[3]]]), len(word))
    at1, at2, at3 = at[: len(a1)], at[len(a1) :], np.searchsorted(word, b3)
    if len(at1):
        yield *one, _counted(at1 * 65536 + b1, one[3], one[2]), count[at1], k.counts[b1], True
    if len(at2):
        after, to = np.unique(b2, return_inverse=True)
        known = [x for x in part if x[0] == FOLLOW]
        h, c = (np.frombuffer(b"".join(x[i] for x in known), t) for i, t in ((5, np.uint64), (4, np.int64)))
        follow = np.zeros(len(after), np.int64)
        if len(after):
            place = np.minimum(np.searchsorted(after, h), len(after) - 1)
            met = after[place] == h  # others follow a word of this part in other texts only
            follow[place[met]] = c[met]
        yield *both, _counted(at2 * len(after) + to, both[3], both[2]), count[at2], follow[to], True
    if len(at3):
        yield *two, _counted(at3 * 65536 + a3, two[3], two[2]), k.counts[a3], count[at3], False


def _grade(rates, k: Classes):
    g, n = _grades(*rates, k.uniform)
    return pa.record_batch({"g": pa.array(g.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _grade_parts(batches, k: Classes):
    for part in _by_part(batches):
        for _, _, train, doc, *counts, _ in _looked_up(part, k):
            out = ~train[doc]
            yield _grade(k.rates(*(c[out] for c in counts)), k)


def _grade_hot(batches, k: Classes, hot: np.ndarray):
    for batch in batches:
        for _, tokens, doc in _sequences(batch.column(0)):
            pair = k.pairs(k.of(tokens), doc)
            a, b = (pair >> np.uint32(16)).astype(np.int64), (pair & np.uint32(0xFFFF)).astype(np.int64)
            x = (a < HOT) & (b < HOT) & (a != k.other) & (b != k.other)
            yield _grade(k.rates(hot[a[x] * HOT + b[x]], k.counts[a[x]], k.counts[b[x]]), k)


_SUMS = "row long, n_tokens long, n_known long, base double, score double"


def _sums(row, tokens=None, known=None, base=None, score=None):
    zero = np.zeros(len(row), np.int64)
    cols = [row, zero if tokens is None else tokens, zero if known is None else known, zero if base is None else base, zero if score is None else score]
    kinds = [np.int64, np.int64, np.int64, float, float]
    return pa.record_batch([pa.array(c.astype(t)) for c, t in zip(cols, kinds, strict=True)], names=["row", "n_tokens", "n_known", "base", "score"])


def _mixed(k: Classes, weights: np.ndarray, *counts) -> np.ndarray:
    b, f2, f1 = k.rates(*counts)
    w = weights[b]
    return np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * k.uniform)


def _score_here(batches, k: Classes, hot: np.ndarray, weights: np.ndarray):
    """For each document what needs no look-up elsewhere."""
    smooth = k.smooth(k.counts)
    for batch in batches:
        rows = _flat(batch, 1)
        for first, tokens, doc in _sequences(batch.column(0)):
            docs = int(doc[-1]) + 1
            cls = k.of(tokens)
            pair = k.pairs(cls, doc)
            a, b = (pair >> np.uint32(16)).astype(np.int64), (pair & np.uint32(0xFFFF)).astype(np.int64)
            x = (a < HOT) & (b < HOT) & (a != k.other) & (b != k.other)
            own = cls != k.other
            yield _sums(
                rows[first : first + docs], np.bincount(doc, minlength=docs),
                np.bincount(doc[own], k.counts[cls[own]] > 0, docs), np.bincount(doc[own], smooth[cls[own]], docs),
                np.bincount(doc[x], _mixed(k, weights, hot[a[x] * HOT + b[x]], k.counts[a[x]], k.counts[b[x]]), docs),
            )


_REPLY = "sender long, rows binary, known binary, base binary, score binary"


def _score_parts(batches, k: Classes, weights: np.ndarray):
    """What each part knows of the documents in a blob goes back as one row, to where the blob's sender is summed up."""
    for part in _by_part(batches):
        for blobs, rows, _, doc, pair, context, word, own in _looked_up(part, k):
            known = base = np.zeros(len(rows))
            if own:  # here each occurrence of a word outside the cache is met once, as a context
                known, base = np.bincount(doc, context > 0, len(rows)), np.bincount(doc, k.smooth(context), len(rows))
            score = np.bincount(doc, _mixed(k, weights, pair, context, word), len(rows))
            at = 0
            for _, sender, x, *_ in blobs:
                to = at + len(x) // 8
                body = [x, *(np.ascontiguousarray(y[at:to], float).tobytes() for y in (known, base, score))]
                yield pa.record_batch([pa.array([sender]), *(pa.array([y], pa.binary()) for y in body)], names=["sender", "rows", "known", "base", "score"])
                at = to


def _summed(batches):
    """Replies sorted by sender: one row for each of its documents."""

    def work(held):
        rows = np.frombuffer(b"".join(x[0] for x in held), np.int64)
        own, at = np.unique(rows, return_inverse=True)
        cols = [np.bincount(at, np.frombuffer(b"".join(x[i] for x in held), float), len(own)) for i in (1, 2, 3)]
        return _sums(own, None, np.rint(cols[0]), cols[1], cols[2])

    now, held, size = None, [], 0
    for batch in batches:
        for sender, *blobs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and (sender != now or size > 1 << 24):
                yield work(held)
                held, size = [], 0
            now = sender
            held.append(blobs)
            size += len(blobs[0])
    if held:
        yield work(held)


@contextlib.contextmanager
def _cleaning(spark):
    """Shuffle files of what is planned and run inside are removed when it has run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 10, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).
    Documents with crc32(id as text) mod folds = 0 are held out; all others are learned from. vocabulary: how many words'
    counts are cached, which changes no result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(F.crc32(F.col(id).cast("string")) % folds == 0, F.lit(False))
    train = F.col(id).isNotNull() & ~held
    kind = docs.schema[id].dataType.simpleString()
    row = F.xxhash64(F.col(id), F.col(text))
    aside = F.pmod(F.xxhash64(row, F.lit("aside")), F.lit(FIT)) == 0
    d = docs.select(F.col(text).alias("text"), row.alias("row"), train.alias("train"), F.col(id).alias("id"), held.alias("held"), aside.alias("aside"))
    learn_from, body = d.where("train").select("text", "aside"), d.select("text", "row", "train")

    words = scratch.table(learn_from.transform(in_arrow, _count_words, "h long, c long, f long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("f").alias("f")))
    total, distinct, put_aside = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    end = int(as_long(np.array([END]))[0])
    top = words.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(min(vocabulary, VOCABULARY)).toArrow()  # at most VOCABULARY rows
    _, ends, ends_aside = words.where(F.col("h") == end).first() or (end, 0, 0)
    k = Classes(np.append(top["h"].to_numpy(), end).astype(np.int64).view(np.uint64), np.append(top["c"].to_numpy(), ends).astype(np.int64), total, distinct)
    left = k.without(np.append(top["f"].to_numpy(), ends_aside).astype(np.int64)[k.order], put_aside)
    hot, hot_left = np.zeros(HOT * HOT, np.int64), np.zeros(HOT * HOT, np.int64)
    cells = learn_from.transform(in_arrow, lambda b: _hot_pairs(b, k), "cell int, c long, f long").groupBy("cell").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).toArrow()  # HOT squared rows at most
    hot[cells["cell"].to_numpy()] = cells["c"].to_numpy()
    hot_left[cells["cell"].to_numpy()] = cells["c"].to_numpy() - cells["f"].to_numpy()
    parts = max(8, -(-total // PART))

    follow = scratch.table(body.select("text").transform(in_arrow, lambda b: _follow(b, k, parts), "part int, h long").distinct().join(words, "h").select("part", "h", "c", "f"))

    def sent(docs: DataFrame, count) -> DataFrame:
        known = follow.select("part", "h", count).transform(in_arrow, _follow_blobs, _BLOBS)
        blobs = docs.transform(in_arrow, lambda b: _send(b, k, parts), _BLOBS).union(known)
        return blobs.repartition(parts, "part").sortWithinPartitions("part", "kind")

    with _cleaning(spark):
        # Here a text counts as one learned from if it isn't set aside, and those set aside are what is to be explained.
        graded = sent(d.where("train").select("text", "row", (~F.col("aside")).alias("train")), F.col("c") - F.col("f")).transform(in_arrow, lambda b: _grade_parts(b, left), "g long, n long")
        graded = graded.union(d.where("train and aside").select("text").transform(in_arrow, lambda b: _grade_hot(b, left, hot_left), "g long, n long"))
        grades = graded.groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # bounded: buckets and two grades of rates
    weights = learn(grades["g"].to_numpy(), grades["n"].to_numpy().astype(float), k.uniform) if total else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    replies = sent(body, F.col("c")).transform(in_arrow, lambda b: _score_parts(b, k, weights), _REPLY)
    sums = replies.repartition("sender").sortWithinPartitions("sender").transform(in_arrow, _summed, _SUMS)
    here = body.select("text", "row").transform(in_arrow, lambda b: _score_here(b, k, hot, weights), _SUMS)
    ids = d.select("row", "id", "held")
    sums = sums.union(here).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    # Rows that say the same share a sum, which is so many times that of one.
    out = ids.groupBy("row").agg(F.first("id").alias("id"), F.first("held").alias("held"), F.count("*").alias("copies")).join(sums, "row")
    out = out.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = lambda c, t: (F.col(c) / F.col("copies")).cast(t)
    return out.select(
        F.col("id").cast(kind).alias(id), F.col("held").alias("held_out"), each("n_tokens", "long").alias("n_tokens"), each("n_known", "long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), each("base", "double").alias("base_score"), each("score", "double").alias("score"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
