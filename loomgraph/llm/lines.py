"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Method. A line is a sequence of words parted by single spaces; two lines are near when one word inserted, deleted or
replaced makes them equal. Every line within reach emits its variants, itself with one word deleted, as hashed keys: equal
keys (with the place of the deletion, for a replaced word; with a whole line's key, for an inserted one) meet in a
join, the words are compared, and of near lines the earlier one, by id and place in the text, stays. A key's group is
joined with its earliest line only: two lines with one variant at the same place are near each other whatever they are,
so the earliest is a witness against every other, and no group is expanded into pairs.

Equal lines are merged first. Then lines that can't be near any other are set aside, without loss: a near line shares its
first or its last half (4 words for every 8) with another line. Only the rest, few in most corpora, emit variants. Keys of
variants are exclusive-ors of hashes of (word, place), so each takes constant time however long its line is.

A line goes if the same line stands earlier, or if an earlier line is near it and both have at least 8 words (shorter ones
would differ in too large a part). Blank lines stay. Rows that say the same (id and text) count as one document.

Cases. Null or empty text: no lines, nothing goes. Null id: nothing goes, and nothing goes on its account. Lines of any
length are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch

NEAR_WORDS = 8
#: Bytes that are broadcast at most, of rows of 40 bytes and 4 for each place.
BROADCAST_BYTES = 32 << 20


def _halves():
    """Keys of the first and the last words of a line that a near line must share one of."""
    n = F.col("n")
    h = (F.floor(n / 8) * 4).cast("int")
    less = h - 4
    key = lambda tag, words, size: F.xxhash64(F.lit(tag), size, words)
    first, last = lambda x: F.slice("w", F.lit(1), x), lambda x: F.slice("w", n - x + 1, x)
    each = F.array(key(0, first(h), h), key(1, last(h), h))
    # A line of 8 j words may be near one of 8 j - 1, whose halves are shorter.
    more = F.array(key(0, first(less), less), key(1, last(less), less))
    return F.when(n < NEAR_WORDS, F.array().cast("array<bigint>")).when((n % 8 == 0) & (n >= 2 * NEAR_WORDS), F.concat(each, more)).otherwise(each)


def _near(a: str, b: str):
    """Whether two arrays of words are equal but for one word inserted, deleted or replaced."""
    same = F.when(F.size(a) >= F.size(b), F.col(b)).otherwise(F.col(a))  # the shorter
    long = F.when(F.size(a) >= F.size(b), F.col(a)).otherwise(F.col(b))
    at = F.array_position(F.zip_with(same, F.slice(long, F.lit(1), F.size(same)), lambda x, y: x != y), True)
    rest = lambda x, skip: F.slice(x, (at + skip).cast("int"), F.greatest(F.size(x) - (at + skip).cast("int") + 1, F.lit(0)))
    replaced = rest(same, 1) == rest(long, 1)
    inserted = rest(same, 0) == rest(long, 1)
    return F.when(F.size(same) == F.size(long), (at == 0) | replaced).when(F.size(long) - F.size(same) == 1, (at == 0) | inserted).otherwise(False)


def _variants(lines: DataFrame) -> DataFrame:
    """(key, role, line) from lines(line, w, n): role 0, one word replaced at a place; 1, a word less; 2, the line itself."""
    words = lines.select("line", "n", F.posexplode("w").alias("i", "x"))
    words = words.select("line", "n", "i", F.xxhash64("x", "i").alias("p"), F.xxhash64("x", F.col("i") - 1).alias("q"))
    before = "bit_xor(p) over (partition by line order by i rows between unbounded preceding and 1 preceding)"
    after = "bit_xor(q) over (partition by line order by i rows between 1 following and unbounded following)"
    whole = "bit_xor(p) over (partition by line)"
    v = words.select("line", "n", "i", F.expr(f"coalesce({before}, 0L) ^ coalesce({after}, 0L)").alias("d"), F.expr(whole).alias("s"))
    each = F.array(
        F.struct(F.xxhash64(F.lit(0), "d", "n", "i").alias("key"), F.lit(0).cast("tinyint").alias("role")),
        F.struct(F.xxhash64(F.lit(1), "d", F.col("n") - 1).alias("key"), F.lit(1).cast("tinyint").alias("role")),
    )
    own = F.array(F.struct(F.xxhash64(F.lit(1), "s", "n").alias("key"), F.lit(2).cast("tinyint").alias("role")))
    return v.select("line", F.explode(F.when(F.col("i") == 0, F.concat(each, own)).otherwise(each)).alias("e")).select("e.key", "e.role", "line")


def removed(scratch: Scratch, docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, row, gone): the places, from 0, of the lines that go from each row that loses any. row: the text's hash."""
    d = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    d = d.withColumn("row", F.xxhash64("text"))
    each = d.select("id", "row", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.trim("line") != "")
    w = each.withColumn("w", F.split(F.trim("line"), " ")).withColumn("n", F.size("w"))
    # The array is named once, so that the line is parted once.
    w = w.select(F.struct("id", "row", "place").alias("at"), F.unhex(F.md5(F.trim("line"))).alias("k"), _halves().alias("half"))
    lines = scratch.table(w)
    known = scratch.table(lines.groupBy("k").agg(F.min("at").alias("first"), F.count("*").alias("copies"), F.first("half").alias("half")))

    halves = known.select("k", "first", F.explode("half").alias("h"))
    shared = halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    near = scratch.table(halves.join(shared, "h").select("k", "first").distinct())
    place = near.groupBy("first.id", "first.row").agg(F.collect_set("first.place").alias("places"))
    size = place.agg(F.sum(40 + 4 * F.size("places"))).first()[0] or 0
    place = F.broadcast(place) if size <= BROADCAST_BYTES else place
    picked = d.join(place, ["id", "row"]).dropDuplicates(["id", "row"]).select("id", "row", "places", F.split("text", "\n").alias("all"))
    picked = picked.select("id", "row", F.explode("places").alias("place"), "all").select(F.struct("id", "row", "place").alias("at"), F.trim(F.element_at("all", F.col("place") + 1)).alias("line"))
    # Numbered in the order of ids and places, before they are written, so that a smaller number is an earlier line.
    picked = picked.select("at", F.unhex(F.md5("line")).alias("k"), F.split("line", " ").alias("w")).orderBy("at")
    numbered = scratch.table(picked.withColumn("n", F.size("w")).withColumn("line", F.monotonically_increasing_id()))

    variants = scratch.table(_variants(numbered))
    whole = F.col("role") == 2
    heads = variants.groupBy("key").agg(F.min(F.when(~whole, F.col("line"))).alias("part"), F.min(F.when(whole, F.col("line"))).alias("whole"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = variants.join(heads, "key")
    met = met.withColumn("by", F.when(F.col("role") == 1, F.col("whole")).otherwise(F.col("part"))).where("by < line").select("line", "by").distinct()
    words = numbered.select("line", "w")
    met = met.join(words, "line").join(words.select(F.col("line").alias("by"), F.col("w").alias("v")), "by").where(_near("w", "v")).select("line").distinct()
    gone = numbered.join(met, "line").select("k").withColumn("near", F.lit(True))

    some = known.select("k", "first", "copies").join(gone, "k", "left").where("copies > 1 or near")
    out = lines.select("k", "at").join(some, "k").where("near or at <> first")
    out = scratch.table(out.groupBy("at.id", "at.row").agg(F.collect_set("at.place").alias("gone")))
    scratch.drop(lines, known, near, numbered, variants)
    return out


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines that repeat earlier ones taken out of text, and the columns n_lines and n_removed (these take
    the place of columns of the same names)."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removed(scratch, docs, id, text).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    d = docs.withColumn("__h", F.xxhash64(text)).join(gone, (F.col(id) == F.col("__id")) & (F.col("__h") == F.col("__row")), "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
    keep = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    cols = {c: F.col(c) for c in keep} | {text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)}
    order = [c for c in docs.columns if c in cols]
    return d.select(*[cols[c].alias(c) for c in order], n.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP3_SQL = r"""
WITH e AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM e),
l AS (SELECT doc_id, place, trim(line, ' ') AS line FROM o WHERE trim(line, ' ') <> ''),
d AS (SELECT line, min({'i': doc_id, 'p': place}) AS first FROM l GROUP BY line),
w AS (SELECT line, first, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n FROM d),
v AS (
  SELECT line, first, n, unnest(range(1, n + 1)) AS i, w FROM w WHERE n >= 8),
x AS (SELECT line, first, n, i, md5(array_to_string(w[1:i-1] || w[i+1:n], ' ')) AS y FROM v),
r AS (SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY y, n, i) AS least FROM x) WHERE least < first),
s AS (SELECT line, first, n, md5(line) AS y FROM w WHERE n >= 8),
a AS (SELECT x.line FROM x JOIN s ON x.y = s.y AND s.n = x.n - 1 WHERE s.first < x.first),
b AS (SELECT s.line FROM x JOIN s ON x.y = s.y AND s.n = x.n - 1 WHERE x.first < s.first),
g AS (SELECT line FROM r UNION SELECT line FROM a UNION SELECT line FROM b),
z AS (
  SELECT l.doc_id, l.place, (g.line IS NOT NULL OR d.first <> {'i': l.doc_id, 'p': l.place}) AS gone
  FROM l JOIN d ON l.line = d.line LEFT JOIN g ON l.line = g.line),
t AS (
  SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.place) FILTER (WHERE NOT coalesce(z.gone, false)) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE z.gone) AS n_removed
  FROM o LEFT JOIN z ON o.doc_id = z.doc_id AND o.place = z.place GROUP BY o.doc_id)
SELECT doc_id, CASE WHEN coalesce(documents.text, '') = '' THEN 0 ELSE coalesce(n_lines, 0) END AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t.text, '')) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""
