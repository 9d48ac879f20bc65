"""MinHash, banded joins and entity resolution (§2.12)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import acronym, capitals, char_shingles, jaccard, meaningful_tokens, name_tokens, normalize_name
from loomgraph.operators.graph import components, cut


#: Sets of one token that a part of it may hold, where all of a token meet.
MET = 4096


def minhash(shingles, k: int = 128) -> Column:
    """SIM-1: for each of k seeds the least hash of the set's members."""
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda s: F.array_min(F.transform(shingles, lambda g: F.xxhash64(s, g))))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of those of pairs(a, b) whose sets(id, s) are alike. Only sets that are in a pair are made and sent."""
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(sets.join(cut(ids), "id", "left_semi"))
    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return j.select("a", "b", jaccard("x", "y").alias("jaccard")).where(F.col("jaccard") >= threshold)


def _met(bands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs of bands(id, band, h): each id with the least of its bucket first; those that aren't like it, with all in
    the bucket. Two that are both like the least are joined by it, so a bucket of copies makes as many pairs as it has
    members, every id with a smaller one like it has such a pair, and components are those of all pairs."""
    least = bands.groupBy("band", "h").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = cut(bands.join(least, ["band", "h"]).where("a < id"))
    first = later.select("a", F.col("id").alias("b")).distinct()
    near = cut(_verified(first, sets, threshold))
    rest = later.join(near.select("a", F.col("b").alias("id")), ["a", "id"], "left_anti").select("band", "h", F.col("id").alias("x"))
    more = rest.join(bands, ["band", "h"]).where("x <> id").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    return near.union(_verified(more.join(first, ["a", "b"], "left_anti"), sets, threshold))


def _banded(df: DataFrame, id: str, shingles: Column, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Sets (id, s), and (id, t, h) of each band that others share: t, the set as sorted hashes, goes with the id, so that pairs are
    judged where they meet and only those that are alike go on."""
    s = cut(df.select(F.col(id).alias("id"), shingles.alias("s")))
    m = s.select("id", minhash(F.col("s"), bands * rows).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("m", b * rows + 1, rows)))
    one = cut(m.select("id", F.explode(each).alias("h")))
    shared = one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    t = s.select("id", F.array_sort(F.transform("s", lambda x: F.hash(x))).alias("t"))
    return s, one.join(shared, "h", "left_semi").join(t, "id").select("id", "t", "h")


def _alike(x, y, threshold: float) -> Column:
    """Whether sets of hashes may be alike: sizes first. Hashes of two members that clash make one of both, so what seems to be
    lacking is allowed for and the sets themselves decide later."""
    n = F.size(x), F.size(y)
    return (F.least(*n) >= F.greatest(*n) * threshold - 1e-9) & (F.size(F.array_intersect(x, y)) >= (n[0] + n[1]) * (threshold / (1 + threshold)) - 1e-9 - _clashes(x) - _clashes(y))


def _clashes(x) -> Column:
    return F.size(x) - F.size(F.array_distinct(x))


def similar_pairs(df: DataFrame, id: str, shingles: Column, threshold: float, bands: int = 32, rows: int = 4) -> DataFrame:
    """SIM-2, SIM-3, JN-9: (a, b, jaccard) with a < b of all that share a band of minhashes, verified on the sets. Pairs of a
    bucket are its output, so a group of N copies has N squared; to group or to drop copies, use linked_pairs."""
    s, band = _banded(df, id, shingles, bands, rows)
    band = cut(band)
    p = band.alias("a").join(band.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & _alike(F.col("a.t"), F.col("b.t"), threshold))
    return _verified(p.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), s, threshold)


def linked_pairs(df: DataFrame, id: str, shingles: Column, threshold: float, bands: int = 32, rows: int = 4) -> DataFrame:
    """SIM-5: pairs (a, b, jaccard) that tell which names have a similar one, without all pairs of a group of copies: as _met, with
    sets that go with their ids."""
    s, band = _banded(df, id, shingles, bands, rows)
    band = cut(band)
    least = band.groupBy("h").agg(F.min("id").alias("a"), F.min_by("t", "id").alias("x"))
    later = cut(band.join(least, "h").where("a < id").select("h", "id", "t", "a", _alike(F.col("x"), F.col("t"), threshold).alias("near")))
    near = cut(_verified(later.where("near").select("a", F.col("id").alias("b")).distinct(), s, threshold))
    rest = later.join(near.select("a", F.col("b").alias("id")), ["a", "id"], "left_anti").select("h", F.col("id").alias("x"), F.col("t").alias("u"))
    more = rest.join(band, "h").where((F.col("x") != F.col("id")) & _alike(F.col("u"), F.col("t"), threshold))
    more = more.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")
    return near.union(_verified(more, s, threshold))


def exact_pairs(df: DataFrame, id: str, shingles: Column, threshold: float) -> DataFrame:
    """SIM-3, exactly: pairs that share one of the first tokens of their sets, rare tokens first. What follows the token in both
    sets must still make up the overlap that their sizes need. Empty sets are like nothing. Sets go with their ids, in that order,
    so a pair is judged where it meets, at its first token in common, and only pairs that are alike leave the join."""
    s = cut(df.select(F.col(id).alias("id"), shingles.alias("s")).where(F.size("s") > 0))
    count = s.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    ranked = s.select("id", F.explode("s").alias("t")).join(count, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("k"))
    placed = ranked.select("id", "k", F.col("k.t").alias("s"), F.size("k").alias("n"), _bits("k.t").alias("bits"))
    prefix = F.slice("k", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    first = placed.select("id", "s", "n", "bits", F.posexplode(prefix).alias("p", "k"))
    # Sets of a frequent token are dealt into parts on one side, each of which meets all of the other.
    first = cut(first.select("id", "s", "n", "bits", "p", F.col("k.t").alias("t"), F.ceil(F.col("k.c") / MET).cast("int").alias("parts")))
    many = max(48, s.count() // MET)
    part = {"a": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    a, b = (first.select("t", part[x].alias("part"), *[F.col(c).alias(f"{x}_{c}") for c in ("id", "s", "n", "p", "bits")]).repartition(many, "t", "part") for x in ("a", "b"))
    x, y = F.col("a_n"), F.col("b_n")
    need = F.ceil((x + y) * (threshold / (1 + threshold)) - 1e-9)
    lacks = lambda p, q: F.bit_count(F.col(f"{p}_bits").bitwiseAND(F.bitwise_not(F.col(f"{q}_bits"))))  # noqa: E731  tokens that the other set can't have
    fits = (F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9) & (x - F.col("a_p") >= need) & (y - F.col("b_p") >= need)
    fits = fits & (x - lacks("a", "b") >= need) & (y - lacks("b", "a") >= need)
    met = a.join(b, ["t", "part"]).where((F.col("a_id") < F.col("b_id")) & fits)
    # explode_outer of one member: as a plain column, the optimizer would move it into the join and work it out for every pair.
    met = met.select("t", "a_id", "b_id", (x + y).alias("n"), F.explode_outer(F.array(F.array_intersect("a_s", "b_s"))).alias("both"))
    j = F.size("both") / (F.col("n") - F.size("both"))
    return met.where(F.col("both")[0] == F.col("t")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), j.alias("jaccard")).where(F.col("jaccard") >= threshold)


def _bits(c: str) -> Column:
    """A word with a bit for each member of a set, by its hash."""
    return F.aggregate(F.transform(c, lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def similar_documents(docs: DataFrame, id: str, text: str, threshold: float, n: int = 3, bins: int = 64, rows: int = 4) -> DataFrame:
    """SIM-2, SIM-8 for long texts: (a, b, jaccard) of sets of n-word shingles. Each shingle is hashed once and falls into
    one of `bins` bins, whose least members make the signature: one aggregation instead of a hash for every seed. As in
    linked_pairs, a group of copies has as many pairs as members."""
    w = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    d = docs.select(F.col(id).alias("id"), w.alias("w")).where(F.size("w") > 0)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, n)))
    s = d.select("id", F.array_distinct(grams).alias("s"))
    # explode_outer: for explode, the optimizer would infer a filter that computes the array's size from the text again.
    least = s.select("id", F.explode_outer("s").alias("h")).groupBy("id", F.pmod("h", F.lit(bins)).alias("bin")).agg(F.min("h").alias("h"))
    band = least.groupBy("id", F.floor(F.col("bin") / rows).alias("band")).agg(F.xxhash64(F.array_sort(F.collect_list("h"))).alias("h"))
    return _met(cut(band), s, threshold)


def groups(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """SIM-6: (id, component) of names(id) over pairs(a, b)."""
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), names)


def drop_near_duplicates(docs: DataFrame, id: str, text: str, threshold: float = 0.9) -> DataFrame:
    """SIM-8, JN-10: documents without the later of each similar pair."""
    p = similar_documents(docs, id, text, threshold)
    return docs.join(p.select(F.col("b").alias(id)).distinct(), id, "left_anti")


def best_match(names: DataFrame, known: DataFrame, threshold: float = 0.6) -> DataFrame:
    """SIM-4, JN-11, JN-12: for each of names(name) the best of known(name): the same (1), normalised the same (0.95), an
    abbreviation (0.9), else words in common (x 0.9), meaning words (x 0.85) or the sequence of characters (x 0.75). Ties go
    to the shorter, then the larger name. Equal and abbreviated names and those with a word in common meet in joins, and by
    characters each name that none equals is held against all known ones."""
    prep = lambda d, p: cut(d.select("name").where("name is not null").distinct().select(F.col("name").alias(p), normalize_name("name").alias(f"{p}n"), name_tokens(F.col("name")).alias(f"{p}t"), meaningful_tokens(F.col("name")).alias(f"{p}m"), F.coalesce(acronym(F.col("name")), F.lit("")).alias(f"{p}a"), F.coalesce(capitals(F.col("name")), F.lit("")).alias(f"{p}c"), F.upper("name").alias(f"{p}u")))
    a, b = prep(names, "x"), prep(known, "y")
    same = cut(a.select("x", "xn").join(b.select("y", "yn"), F.col("xn") == F.col("yn")).select("x", "y", F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.95).alias("score")))
    out = same.where(F.col("score") >= threshold)
    a = cut(a.join(out.select("x").distinct(), "x", "left_anti"))  # what follows scores 0.9 at most
    for p, q in (("xa", "yu"), ("xu", "ya"), ("xc", "yu"), ("xu", "yc")):
        short = a.where(F.col(p) != "").select("x", p).join(b.where(F.col(q) != "").select("y", q), F.col(p) == F.col(q))
        out = out.union(short.select("x", "y", F.lit(0.9).alias("score")).where(F.lit(0.9 >= threshold)))
    near = F.greatest(0.9 * jaccard("xt", "yt"), 0.85 * jaccard("xm", "ym"))
    word = a.select("x", "xt", "xm", F.explode("xt").alias("k")).join(b.select("y", "yt", "ym", F.explode("yt").alias("k")), "k")
    out = out.union(word.select("x", "y", near.alias("score")).where(F.col("score") >= threshold))
    if threshold <= SEQUENCE:
        out = out.union(_by_characters(a.select("x", "xn"), b.select("y", "yn"), threshold))
    w = Window.partitionBy("x").orderBy(F.desc("score"), F.length("y"), F.desc("y"))
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("x").alias("name"), F.col("y").alias("match"), "score")


#: What likeness by characters counts, names of a block, names and pairs that are compared at once.
SEQUENCE, BLOCK, TILE, AT_ONCE = 0.75, 32_768, 2048, 1 << 16
#: Characters are dealt into so many kinds, of each of which so many occurrences count.
KINDS, OCCURRENCES = 32, 3


def _by_characters(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(x, y, score) of a(x, xn) and b(y, yn): of each x the best of each block of y by sequence_ratio, if it reaches the
    threshold. All pairs are bounded by the characters that they share, then by their longest common subsequence, and measured
    from the highest bound down until it falls below the best. Each task holds a block of either side."""
    sides = []
    blocks = [max(least, -(-d.count() // BLOCK)) for d, least in ((a, 24), (b, 2))]
    for d, c, own, other in ((a, "x", "i", "j"), (b, "y", "j", "i")):
        here, there = blocks if c == "x" else blocks[::-1]
        d = d.select(F.col(c).alias("name"), F.col(f"{c}n").alias("plain"), F.pmod(F.xxhash64(c), F.lit(here)).cast("int").alias(own))
        d = d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(there - 1))))
        sides.append(d.repartition(2 * blocks[0] * blocks[1], "i", "j"))
    pairs = sides[0].groupBy("i", "j").cogroup(sides[1].groupBy("i", "j"))
    return pairs.applyInPandas(lambda x, y: _best_of_block(x, y, threshold), "x string, y string, score double")


def _counted(names: list[str]) -> np.ndarray:
    """A row for each name with a 1 for each of the first occurrences of each kind of characters."""
    out = np.zeros((len(names), KINDS * OCCURRENCES), np.float32)
    for row, name in zip(out, names, strict=True):
        for kind, n in Counter(ord(c) % KINDS for c in name).items():
            row[kind * OCCURRENCES : kind * OCCURRENCES + min(n, OCCURRENCES)] = 1
    return out


def _subsequences(at: np.ndarray, codes: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of pairs, in bits of a word: at has the places of each character in one
    name, codes the characters of the other; what the one has beyond 64 characters, over, counts as shared."""
    free, row = np.full(len(at), ~np.uint64(0)), np.arange(len(at))
    for k in range(codes.shape[1]):
        met = free & at[row, codes[:, k]]
        free = (free + met) | (free - met)
    return np.bitwise_count(~free) + over


def _matched(x: str, y: str) -> int:
    """The characters in matching blocks, as difflib finds them: the longest common part, the first in x and then in y, and so on
    on both sides of it."""
    for n in range(min(len(x), len(y)), 0, -1):
        for i in range(len(x) - n + 1):
            j = y.find(x[i : i + n])
            if j >= 0:
                return n + _matched(x[:i], y[:j]) + _matched(x[i + n :], y[j + n :])
    return 0


def _ratio(x: str, y: str) -> float:
    from difflib import SequenceMatcher

    if len(y) >= 200 or len(x) >= 200:  # difflib leaves out characters that are frequent in a long text
        return SequenceMatcher(None, x, y).ratio()
    return 2.0 * _matched(x, y) / (len(x) + len(y))


def _best_of_block(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> pd.DataFrame:
    out, x, y, others = [], a["plain"].to_list(), b["plain"].to_list(), b["name"].to_list()
    kinds = {c: k for k, c in enumerate(sorted(set("".join(x))), 1)}
    long = np.array([len(s) for s in y], np.float32)
    codes, ones = np.zeros((len(y), int(long.max(initial=0))), np.int32), _counted(y)
    for row, name in zip(codes, y, strict=True):
        row[: len(name)] = [kinds.get(c, 0) for c in name]
    for p in range(0, len(x), TILE):
        part = x[p : p + TILE]
        mine, size = _counted(part), np.array([len(s) for s in part], np.float32)
        over = size - mine.sum(1)  # occurrences that aren't counted may be shared
        at = np.zeros((len(part), len(kinds) + 1), np.uint64)
        for row, name in zip(at, part, strict=True):
            for k, c in enumerate(name[:64]):
                row[kinds[c]] |= np.uint64(1 << k)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q in range(0, len(y), TILE):
            theirs = slice(q, q + TILE)
            least = (size[:, None] + long[theirs]) * np.float32(threshold / SEQUENCE / 2) - np.float32(1e-3)
            rows, cols = np.nonzero(mine @ ones[theirs].T + over[:, None] >= least)
            for k in range(0, len(rows), AT_ONCE):
                i, j = rows[k : k + AT_ONCE], cols[k : k + AT_ONCE]
                reach = int(long[theirs][j].max())
                common = _subsequences(at[i], codes[q + j, :reach], np.maximum(size[i] - 64, 0))
                fits = common >= least[i, j]
                i, j, common = i[fits], j[fits] + q, common[fits]
                found.append((i, j, 2.0 * common / (size[i] + long[j])))
        i, j, bound = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((-bound, i))
        best: dict[int, tuple] = {}
        for row, col, most in zip(i[order].tolist(), j[order].tolist(), bound[order].tolist(), strict=True):
            now = best.get(row)
            if now is not None and most < now[0] - 1e-6:
                continue
            ratio, other = _ratio(part[row], y[col]), others[col]
            new = ratio, -len(other), other
            if SEQUENCE * ratio >= threshold and (now is None or new > now):
                best[row] = new
        out += [(a["name"].iat[p + row], other, SEQUENCE * ratio) for row, (ratio, _, other) in best.items()]
    return pd.DataFrame(out, columns=["x", "y", "score"])


def resolve(entities: DataFrame, edges: DataFrame, threshold: float = 0.6):
    """SIM-7: (entities, edges, mapping): similar names become one entity; edges follow. entities: id, name, ord, ..."""
    from loomgraph.operators.relational import merge_resolved_edges, merge_resolved_entities, remap_edges

    names = entities.select(normalize_name("name").alias("id")).distinct()
    pairs = linked_pairs(names, "id", char_shingles(F.col("id")), threshold)
    of = groups(names, pairs).select(F.col("id").alias("norm"), F.col("component").alias("grp"))
    grouped = entities.withColumn("norm", normalize_name("name")).join(of, "norm").drop("norm")
    merged = merge_resolved_entities(grouped)
    head = grouped.select("grp", F.col("id").alias("old")).join(grouped.join(merged.select("id"), "id", "left_semi").select("grp", F.col("id").alias("new")).distinct(), "grp").select("old", "new")
    return merged, merge_resolved_edges(remap_edges(edges, head)), head
