"""N-gram Jaccard join by a token-group matrix.

Method. A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents with equal sets are one class.
Similar documents are partitioned into groups; the matrix holds each group's union of tokens. A query's overlap with any
member of a group is at most its overlap with the union, so only groups whose bound reaches the threshold are opened.

The matrix is kept sparse without losing a link. Under one order of tokens for all, rare ones first, sets with Jaccard >= t
share one of their first n - ceil(t n) + 1 tokens each; only these are stored. The first token in common of two sets stands
so near the start of both that what follows it still makes up the overlap that they need, which bounds the sizes of the
partners that a token can stand for; so the matrix is kept by token, band of sizes and group, and a query asks only for
bands that its token's place allows. Groups that it meets there are bounded by the sum of the tokens that the query shares with
their union, and what is beyond the first tokens; members of those that reach the threshold are opened and compared.

Groups grow in a few rounds before that: each token has a hub among its classes, first that with the fewest rare tokens
(near copies of one text have that text in common, and rare tokens where they were changed), then another; classes are compared
with the hubs that they share many tokens with, and links make the groups (components). Inside a group nothing more is
compared. So a group of thousands of near copies costs a few times as many comparisons as it has members, and components
are exact.

How frequent a token is bears on speed alone. All tokens of all documents are counted, by codes of 32 bits in each part;
the number of frequent ones whose grades are sent to the tasks is bounded by raising the limit of frequency.

Hashes. Words, shingles and sets are known by 64-bit hashes that chain mixed blocks. Sets that share a key are told apart by a
second one of 64 bits, and then all keys are formed anew; so classes err with a chance of 2**-128 a pair. Shingles aren't
compared as strings: two that share a hash (2**-64 a pair) count as one in the sets that hold them.

Cases. Null or empty text: an empty set, linked with nothing. Fewer than 5 words: one shingle of the whole sequence. Null
id: linked with nothing, component null. Repeated rows are equal sets and so linked. Texts are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, Words, as_long, chunks, components, in_arrow, mix

SHINGLE, THRESHOLD = 5, 75
#: Tokens of FREQUENT documents or more come later in the order, by doublings; FREQUENT itself doubles until there are at
#: most LISTED of them.
FREQUENT, LISTED = 4, 2_000_000
#: The seed of the keys that prove those of classes; no other seed comes near it.
_PROOF = 1 << 40
#: Rounds in which groups grow before the exact one, and bands of sizes to a factor of e.
ROUNDS, BANDS = 2, 20
#: Tokens that one part counts, on average, and that a task gathers before it sends them.
PART, GATHERED = 3_000_000, 1_000_000
#: Ids (8 bytes each) that are broadcast at most, to fetch the texts of candidates; more are joined by shuffle.
BROADCAST_IDS = 500_000


def shingles(texts: pa.Array, k: int = SHINGLE):
    """(first row, rows, distinct shingle hashes sorted by row, then hash, row of each, words of each row)."""
    for first, buf, off in chunks(texts):
        w = Words(buf, off, lower=True)
        ok = np.flatnonzero(w.inside(k))
        h, doc = w.grams(k)[ok], w.doc[ok]
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        if len(short):
            one = []
            for d in short:
                acc = np.full(1, w.count[d], np.uint64)
                for x in w.hash[w.first[d] : w.first[d + 1]]:
                    acc = mix(acc * np.uint64(3) + x)
                one.append(acc[0])
            h, doc = np.append(h, np.array(one, np.uint64)), np.append(doc, short)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield first, w.docs, h[new], doc[new], w.count


def _keys(h: np.ndarray, doc: np.ndarray, docs: int, seed: int):
    """A 64-bit key of each row's set, which another seed gives anew, and its size."""
    n = np.bincount(doc, minlength=docs)
    ends = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(2 * seed + 1)))))
    return mix((total[ends[1:]] - total[ends[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)), n, ends


def _summaries(batches, k: int, seed: int):
    for batch in batches:
        for first, docs, h, doc, _ in shingles(batch.column(1), k):
            key, n, _ = _keys(h, doc, docs, seed)
            proof = _keys(h, doc, docs, _PROOF)[0]
            yield pa.record_batch([batch.column(0).slice(first, docs), batch.column(2).slice(first, docs), pa.array(n.astype(np.int64)), pa.array(as_long(key)), pa.array(as_long(proof))], names=["id", "row", "n", "k", "proof"])


def _codes(batches, k: int, bits: int):
    """Codes of the tokens, the highest 32 + bits of their hash, packed for each part, which the first bits say."""
    held, size = [], 0

    def flush():
        c = np.sort(np.concatenate(held))
        part = c >> np.uint64(32)
        ends = np.searchsorted(part, np.arange((1 << bits) + 1).astype(np.uint64))
        for p in range(1 << bits):
            if ends[p] < ends[p + 1]:
                yield pa.record_batch({"part": pa.array([p], pa.int32()), "low": pa.array([c[ends[p] : ends[p + 1]].astype(np.uint32).tobytes()], pa.binary())})

    for batch in batches:
        for _, _, h, _, _ in shingles(batch.column(0), k):
            held.append(h >> np.uint64(32 - bits))
            size += len(h)
            if size >= GATHERED:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _runs(batches, columns: list[int]):
    """(part, its columns' blobs) of a task's rows sorted by part, at most about PART * 8 * 4 bytes at once: (part, whole, blobs)."""
    now, held, size, split = None, [[] for _ in columns], 0, False
    for batch in batches:
        for i, p in enumerate(batch.column(0).to_pylist()):
            if held[0] and (p != now or size > PART * 32):
                split = split or p == now
                yield now, not split, held
                split = p == now
                held, size = [[] for _ in columns], 0
            now = p
            for x, c in zip(held, columns, strict=True):
                x.append(batch.column(c)[i].as_py())
            size += len(held[-1][-1])
    if held[0]:
        yield now, not split, held


def _frequent(batches, least: int):
    for p, _, (low,) in _runs(batches, [1]):
        c, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in low]), return_counts=True)
        c, n = c[n >= least].astype(np.uint64) | np.uint64(p << 32), n[n >= least]
        yield pa.record_batch({"code": pa.array(as_long(c)), "n": pa.array(n.astype(np.int64))})


def _prefixes(batches, k: int, seed: int, parts: int, bits: int, frequent: np.ndarray, grade: np.ndarray, t: int):
    """The first tokens of each set in the common order, packed for each part: classes, sizes, shares of rare tokens (in
    thousandths), counts, places, tokens."""
    held, size = [], 0
    names = ["part", "k", "n", "rare", "counts", "places", "tokens"]

    def flush():
        key, n, rare = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
        before = np.cumsum([0, *(len(x[0]) for x in held)])
        doc = np.concatenate([x[3] + y for x, y in zip(held, before, strict=False)])
        tok, place = np.concatenate([x[4] for x in held]), np.concatenate([x[5] for x in held])
        _, one = np.unique(key, return_index=True)  # equal sets go once
        stays = np.zeros(len(key), bool)
        stays[one] = True
        keep = stays[doc]
        doc, tok, place = doc[keep], tok[keep], place[keep]
        part = mix(tok) % np.uint64(parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        doc, tok, part, place = doc[order], tok[order], part[order], place[order].astype(np.int32)
        ends = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
        for p in range(parts):
            a, b = ends[p], ends[p + 1]
            if a < b:
                own, c = np.unique(doc[a:b], return_counts=True)
                body = [key[own], n[own].astype(np.int32), rare[own].astype(np.int16), c.astype(np.int32), place[a:b], tok[a:b]]
                yield pa.record_batch([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in body)], names=names)

    for batch in batches:
        for _, docs, h, doc, _ in shingles(batch.column(0), k):
            key, n, ends = _keys(h, doc, docs, seed)
            late = np.zeros(len(h), np.uint8)
            if len(frequent):
                code = h >> np.uint64(32 - bits)
                at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
                late[frequent[at] == code] = grade[at[frequent[at] == code]]
            rare = np.bincount(doc, late == 0, docs) * 1000 // np.maximum(n, 1)
            if late.any():
                h = h[np.lexsort((h, late, doc))]  # rows stay where they are, so ends hold
            place = np.arange(len(h)) - ends[doc]
            first = place < n[doc] - (n[doc] * t + 99) // 100 + 1
            held.append((as_long(key), n, rare, doc[first], h[first], place[first]))
            size += int(first.sum())
            if size >= GATHERED:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def _twins(tok: np.ndarray) -> np.ndarray:
    """Which of sorted tokens occur more than once."""
    twin = np.zeros(len(tok), bool)
    twin[1:] = tok[1:] == tok[:-1]
    twin[:-1] |= twin[1:]
    return twin


def _postings(batches):
    """(t, k, n, p, rare) of the tokens that several classes have; of a part that is too large for one run, of all its tokens."""
    for _, whole, (ks, ns, rares, counts, places, toks) in _runs(batches, [1, 2, 3, 4, 5, 6]):
        cat = lambda x, kind: np.concatenate([np.frombuffer(y, kind) for y in x])
        key, n, rare = cat(ks, np.int64), cat(ns, np.int32), cat(rares, np.int16)
        doc = np.repeat(np.arange(len(key)), cat(counts, np.int32))
        tok, place = cat(toks, np.uint64), cat(places, np.int32)
        if whole:
            order = np.argsort(tok)
            order = order[_twins(tok[order])]
            tok, doc, place = tok[order], doc[order], place[order]
        order = np.lexsort((key[doc], tok))
        tok, doc, place = tok[order], doc[order], place[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (key[doc[1:]] != key[doc[:-1]])
        tok, doc, place = tok[new], doc[new], place[new]
        if whole and len(tok):
            twin = _twins(tok)
            tok, doc, place = tok[twin], doc[twin], place[twin]
        yield pa.record_batch({"t": pa.array(as_long(tok)), "k": pa.array(key[doc]), "n": pa.array(n[doc]), "p": pa.array(place), "rare": pa.array(rare[doc])})


def _sets(batches, k: int, seed: int):
    for batch in batches:
        for first, docs, h, doc, _ in shingles(batch.column(0), k):
            key, n, ends = _keys(h, doc, docs, seed)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_long(h)))
            yield pa.record_batch({"k": pa.array(as_long(key)), "set": lists})


def _check(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Of pairs(a, b), those with 100 * intersection >= t * union. The sets of both sides are brought to each pair."""
    j = pairs.join(sets.select(F.col("k").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return j.where(100 * both >= t * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _need(n, m, t: int):
    """The least number of tokens in common with which sets of n and m reach the threshold."""
    return F.floor((t * (n + m) + 99 + t) / (100 + t))


def _band(n):
    return F.floor(F.log(n) * BANDS).cast("int")


def _promising(shared, n, m, t: int):
    """Whether sets that share so many of their first tokens are worth a comparison before the exact round."""
    return shared + F.least(n, m) * t / 100.0 + 2 >= _need(n, m, t)


def _fetch(scratch: Scratch, d: DataFrame, reps: DataFrame, classes: DataFrame, k: int, seed: int) -> DataFrame:
    """(k, set) of the classes, from the text of the document that stands for each."""
    ids = scratch.table(reps.join(classes.distinct(), "k").select("id").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return scratch.table(d.join(ids, "id").select("text").transform(in_arrow, lambda b: _sets(b, k, seed), "k long, set array<long>"))


def links(scratch: Scratch, docs: DataFrame, id: str, text: str, k: int = SHINGLE, t: int = THRESHOLD):
    """(summary(id, row, n, k), components(node, component) of classes) of all rows."""
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    seed = 0
    while True:
        summary = scratch.table(d.transform(in_arrow, lambda b, seed=seed: _summaries(b, k, seed), d.select("id", "row").schema.add("n", "long").add("k", "long").add("proof", "long")))
        if not summary.groupBy("k").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).where("a <> b").take(1):
            break
        seed += 1  # two sets share a key: all keys anew, by the next seed
        scratch.drop(summary)
    total = summary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    body = d.where("id is not null").select("text")

    bits = max(5, min(20, int(-(-total // PART)).bit_length()))
    codes = body.transform(in_arrow, lambda b: _codes(b, k, bits), "part int, low binary").repartition(1 << bits, "part").sortWithinPartitions("part")
    often = scratch.table(codes.transform(in_arrow, lambda b: _frequent(b, FREQUENT), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    least = FREQUENT
    while often.where(F.col("n") >= least).count() > LISTED:
        least *= 2
    listed = often.where(F.col("n") >= least).orderBy("code").toArrow()  # at most LISTED rows
    frequent, grade = listed["code"].to_numpy().view(np.uint64), np.frexp(listed["n"].to_numpy().astype(float))[1].astype(np.uint8)

    parts = max(8, int(-(-total // (4 * PART))) * 2)
    blobs = body.transform(in_arrow, lambda b: _prefixes(b, k, seed, parts, bits, frequent, grade, t), "part int, k binary, n binary, rare binary, counts binary, places binary, tokens binary")
    postings = scratch.table(blobs.repartition(parts, "part").sortWithinPartitions("part").transform(in_arrow, _postings, "t long, k long, n int, p int, rare short"))
    scratch.drop(often)

    like = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * t
    reps = summary.where("id is not null and n > 0").groupBy("k").agg(F.min("id").alias("id"))
    tested, found, groups = None, None, None
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def compare(pairs: DataFrame) -> bool:
        """Compares new pairs; whether any are linked."""
        nonlocal tested, found, groups
        new = scratch.table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if not new.take(1):
            tested = tested or new
            return False
        sets = _fetch(scratch, d, reps, new.select(F.explode(F.array("a", "b")).alias("k")), k, seed)
        linked = scratch.table(_check(new, sets, t))
        scratch.drop(sets)
        tested = new if tested is None else tested.union(new)
        found = linked if found is None else found.union(linked)
        if linked.take(1):
            groups = scratch.table(components(scratch, found))
            return True
        return False

    def grouped(rows: DataFrame) -> DataFrame:
        """(t, k, n, p, rare, g): rows of postings of tokens that several groups have."""
        if groups is None:
            return rows.withColumn("g", F.col("k"))
        of = rows.join(groups.withColumnRenamed("node", "k"), "k", "left").select("t", "k", "n", "p", "rare", F.coalesce("component", "k").alias("g"))
        mixed = of.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("t")
        return of.join(mixed, "t")

    # The rounds before the exact one take only classes that share many tokens with any other.
    own = postings.groupBy("k", "n").agg(F.count("*").alias("c")).where(_promising(F.col("c"), F.col("n"), F.col("n"), t)).select("k")
    busy = scratch.table(postings.join(own, "k").select(postings.columns))
    for r in range(ROUNDS):
        of = grouped(busy)
        first = [F.xxhash64("k", F.lit(r)).alias("x")] if r else [F.col("rare"), F.xxhash64("k").alias("x")]
        hub = of.groupBy("t").agg(F.min(F.struct(*first, "k", "n", "g")).alias("h")).select("t", F.col("h.k").alias("hk"), F.col("h.n").alias("m"), F.col("h.g").alias("hg"))
        seen = of.join(hub, "t").where((F.col("g") != F.col("hg")) & like(F.col("n"), F.col("m")))
        seen = seen.groupBy("k", "hk", "n", "m").agg(F.count("*").alias("shared")).where(_promising(F.col("shared"), F.col("n"), F.col("m"), t))
        if not compare(seen.select(*pair("k", "hk")).distinct()):
            break
    scratch.drop(busy)

    # The matrix of tokens, bands of sizes and groups, with the earliest place of the token and the sizes of the members.
    # Of two sets the larger, of n, asks; m, the smaller, is at least ceil(t n), and need(n, m) <= n - p bounds it from above.
    of = scratch.table(grouped(postings).withColumn("band", _band(F.col("n"))))
    extent = scratch.table(of.groupBy("g", "band").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("k").alias("one"), (F.min("k") != F.max("k")).alias("several")))
    matrix = of.groupBy("t", "band", "g").agg(F.min("p").alias("mp"), F.min("n").alias("least"), F.max("n").alias("most"))
    n, p, most = F.col("n"), F.col("p"), F.col("most")
    low, high = F.ceil(n * t / 100.0), F.least(n.cast("long"), F.floor((100 + t) * (n - p) / t) - n)
    ask = of.select("t", "k", "n", "p", F.col("g").alias("own"), low.alias("low"), high.alias("high")).where("low <= high")
    ask = ask.withColumn("band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("high")))))
    top = F.least(most, F.col("high"))
    met = ask.join(matrix, ["t", "band"]).where((F.col("own") != F.col("g")) & (F.col("least") <= F.col("high")) & (most >= F.col("low")) & (F.col("mp") <= top - _need(n, top, t)) & (p <= n - _need(n, F.greatest("least", "low"), t)))
    met = scratch.table(met.select("k", "n", "p", "t", "band", "g"))
    # The bound: the tokens shared with a group's union, and what is beyond the first tokens of one of the two. A group of one
    # class is that class, and its bound is the comparison itself.
    rest = lambda x: F.ceil(x * t / 100.0) - 1
    asked = scratch.table(met.select("k", "n", "band", "g").distinct().join(extent, ["g", "band"]))
    alone = asked.where("not several").select("k", "n", F.col("one").alias("s"), F.col("least").alias("m"))
    sums = asked.where("several").select("k", "n", "band", "g", "least", "most").join(of.select("k", "t"), "k").join(of.select("t", "band", "g").distinct(), ["t", "band", "g"])
    sums = sums.groupBy("k", "n", "band", "g", "least", "most").agg(F.count("*").alias("shared"))
    open_ = sums.where(F.col("shared") + F.greatest(rest(n), rest(most)) >= _need(n, F.greatest("least", F.ceil(n * t / 100.0)), t)).select("k", "band", "g")
    # Of a group that is opened, the members that have the token early enough.
    members = of.select("t", "band", "g", F.col("k").alias("s"), F.col("n").alias("m"), F.col("p").alias("sp"))
    need = _need(F.col("n"), F.col("m"), t)
    opened = met.join(open_, ["k", "band", "g"]).join(members, ["t", "band", "g"]).where(like(F.col("n"), F.col("m")) & (F.col("m") <= F.col("n")) & (F.col("p") <= F.col("n") - need) & (F.col("sp") <= F.col("m") - need))
    opened = scratch.table(opened.select("k", "n", "s", "m").union(alone).distinct())
    # What a pair shares of the first tokens, which several groups have, as it is of different groups: one row for each pair.
    first = scratch.table(of.join(opened.select(F.explode(F.array("k", "s")).alias("k")).distinct(), "k", "left_semi").groupBy("k").agg(F.collect_set("t").alias("ts")))
    both = opened.join(first, "k").withColumnRenamed("ts", "x").join(first.select(F.col("k").alias("s"), F.col("ts").alias("y")), "s")
    shared = both.select("k", "n", "s", "m", F.size(F.array_intersect("x", "y")).alias("shared"))
    compare(shared.where(F.col("shared") + rest(F.greatest("n", "m")) >= _need(F.col("n"), F.col("m"), t)).select(*pair("k", "s")).distinct())
    scratch.drop(postings, of, extent, asked, met, opened, first)
    none = scratch.spark.createDataFrame([], "node long, component long")
    return summary, none if groups is None else groups


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links), class (equal sets), and
    row, the hash of its text."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    summary, groups = links(scratch, docs, id, text, k, t)
    reps = summary.where("id is not null and n > 0").groupBy("k").agg(F.min("id").alias("rep"))
    reps = reps.join(groups.withColumnRenamed("node", "k"), "k", "left")
    lowest = reps.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    reps = scratch.table(reps.join(lowest, "component", "left").select("k", F.coalesce("low", "rep").alias("component_id")))
    s = summary.join(reps, "k", "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("id"))
    return s.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("k").alias("class"), "row")


def distinct(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay when one document of each group does: that with the smallest id, and one of rows that say
    the same. Rows without words or without an id stay."""
    found = join(docs, id, text, k, t)
    stay = found.where((F.col("n_shingles") > 0) & (F.col(id) == F.col("component_id"))).groupBy(F.col(id).alias("id")).agg(F.min("row").alias("row"))
    # Of rows that say the same, whose other columns may differ, that with the smallest hash; maps are hashed by their entries.
    parts = [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, kind in docs.dtypes]
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id).alias("id"), F.xxhash64(text).alias("row"), F.xxhash64(*parts).alias("all"))
    one = d.join(stay, ["id", "row"]).groupBy("id").agg(F.min_by("doc", "all").alias("doc")).select("doc.*")
    alone = docs.where(F.col(id).isNull() | F.coalesce(F.col(text), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$"))
    return one.unionByName(alone)


def op10(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("class", "row")
