"""A stored inverted index (SCR-1): postings in blocks by term and shard of documents, each with what bounds its scores.

A segment is a table of blocks (term, shard, n, max_tf, min_len, ids, tfs, lens). It lies in buckets by a hash of the term and is sorted by
term in them, so that a search reads the buckets and row groups of its own terms. A shard holds about SHARD documents of like
length, chosen by a hash of the id, and so a block holds no more than these, however common its term.

A search never sees a text. It reads n, max_tf and min_len of its terms' blocks; their sum for a shard bounds the score of every
document in it. The shards with the highest bounds are scored first; the k-th score found in them is what others must reach, and
only shards whose bound does are opened. So the best k are exact, ties included.

Adding documents writes a segment. Removing some notes their ids, and what they had of each term, so that document frequencies and
the mean length stay those of a fresh index; an id may come back in a later segment. merge() makes one segment of all from the
blocks, not from texts; add() calls it when there are more than SEGMENTS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import words
from loomgraph.operators.graph import cut
from loomgraph.operators.relational import top_per
from loomgraph.operators.retrieval import B, K1
from loomgraph.sources.writers import Store

#: Documents of a shard, grades of length to a doubling, shards that are scored first for each query, and segments beyond which all
#: are merged.
SHARD, GRADES, FIRST, SEGMENTS = 1024, 4, 8, 8
#: Terms of documents that a task forms blocks of, about, unless a shard has more.
AT_ONCE = 1_000_000
_BLOCK = "term string, shard long, n long, max_tf long, min_len int, ids array<string>, tfs array<long>, lens array<int>"


class InvertedIndex:
    """The index `name` in a store. Ids are kept as strings; null and empty texts are documents without terms."""

    def __init__(self, store: Store, name: str, shard: int = SHARD, first: int = FIRST):
        self.store, self.name, self.shard, self.first = store, name, shard, first

    # --- writing ---

    def _table(self, what: str) -> str:
        return f"{self.name}.{what}"

    @property
    def exists(self) -> bool:
        return self.store.exists(self._table("segments"))

    def segments(self) -> list:
        """(segment, docs, length) of each segment; removals have rows of their own, with negative numbers."""
        return sorted(self.store.read(self._table("segments")).collect()) if self.exists else []  # a row for each change since the last merge

    def _note(self, rows: list, fresh: bool = False) -> None:
        known = [] if fresh else [tuple(r) for r in self.segments()]
        self.store.replace(self._table("segments"), self.store.spark.createDataFrame(known + rows, "segment long, docs long, length long"))

    def _next(self) -> int:
        return max((r.segment for r in self.segments()), default=0) + 1

    def _segment(self, number: int, docs: DataFrame, postings: int, placed) -> None:
        """Writes the blocks of a segment. docs(id, len): its documents; placed(docs, with a column shard): (shard, term, id, tf, len).
        Documents of like length share a shard: the least length in a block then bounds its scores well. What has a shard meets in
        one shuffle, and blocks are formed where it arrives."""
        grade = F.floor(F.log2(F.col("len")) * GRADES)
        docs = docs.where("len > 0")
        many = docs.groupBy(grade.alias("grade")).agg(F.ceil(F.count("*") / self.shard).alias("shards"))
        many = self.store.spark.createDataFrame(many.collect(), "grade long, shards long")  # 31 doublings of GRADES rows at most
        shard = F.shiftleft(F.col("grade"), 40) + F.pmod(F.xxhash64("id"), F.col("shards"))
        parts = max(1, min(many.agg(F.sum("shards")).first()[0] or 1, -(-postings // AT_ONCE)))
        each = placed(lambda df: df.join(F.broadcast(many), grade == F.col("grade")).withColumn("shard", shard).drop("grade", "shards").withColumn("id", F.url_encode("id")).repartition(parts, "shard"))
        p = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))
        # On its way to its bucket a block is one text, which takes less than half of what its columns do.
        text = F.concat_ws("\n", *[F.array_join(F.col(f"p.{c}").cast("array<string>"), " ") for c in ("id", "tf", "len")])
        blocks = each.groupBy("term", "shard").agg(p.alias("p")).select("term", "shard", text.alias("p"))
        self.store.replace(self._table(f"s{number}"), blocks, "term", then=self._columns)

    @staticmethod
    def _columns(df: DataFrame) -> DataFrame:
        """Blocks of what _segment sends; ids are there without spaces."""
        part = lambda i: F.split(F.element_at(F.split("p", "\n"), i), " ")
        ids = F.when(F.rlike("p", F.lit("[%+]")), F.transform(part(1), F.url_decode)).otherwise(part(1))
        d = df.withColumns({"ids": ids, "tfs": part(2).cast("array<bigint>"), "lens": part(3).cast("array<int>")})
        more = [c for c in df.columns if c not in ("term", "shard", "p")]  # the bucket
        return d.select("term", "shard", F.size("ids").cast("long").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("lens").alias("min_len"), "ids", "tfs", "lens", *more)

    @staticmethod
    def _parted(docs: DataFrame, text: str) -> DataFrame:
        """(id, len, terms, tfs) of each document: its words are sorted and told apart where it is, without a shuffle."""
        w = docs.select(F.col("id").cast("string").alias("id"), F.sort_array(words(F.coalesce(F.col(text), F.lit("")))).alias("w")).where("id is not null")
        first = F.filter(F.transform("w", lambda x, i: F.when(~x.eqNullSafe(F.get("w", i - 1)), i)), lambda i: i.isNotNull())
        d = w.select("id", "w", F.size("w").alias("len"), first.alias("first"))
        end = F.when(F.col("len") > 0, F.concat(F.slice("first", F.lit(2), F.size("first")), F.array("len"))).otherwise(F.col("first"))
        return d.select("id", "len", F.transform("first", lambda i: F.get("w", i)).alias("terms"), F.zip_with("first", end, lambda x, y: (y - x).cast("long")).alias("tfs"))

    @staticmethod
    def _packed(d: DataFrame) -> DataFrame:
        """Terms and their numbers as texts, for a shuffle; words have no spaces."""
        return d.withColumns({"terms": F.array_join("terms", " "), "tfs": F.array_join(F.col("tfs").cast("array<string>"), " ")})

    @staticmethod
    def _unpacked(d: DataFrame) -> DataFrame:
        return d.withColumns({"terms": F.split("terms", " "), "tfs": F.split("tfs", " ").cast("array<bigint>")})

    @staticmethod
    def _each(d: DataFrame, alone: bool) -> DataFrame:
        """(..., term, id, tf, len) of documents as from _parted; those that have an id and a length in common are one, unless each
        is known to be alone."""
        more = [c for c in d.columns if c not in ("id", "len", "terms", "tfs")]
        each = d.select(*more, "id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(*more, F.col("t.terms").alias("term"), "id", F.col("t.tfs").alias("tf"), "len")
        return each if alone else each.groupBy(*more, "term", "id", "len").agg(F.sum("tf").alias("tf"))

    @staticmethod
    def _size(d: DataFrame) -> tuple[int, int, int, bool]:
        """Documents, words, terms of documents, and whether no two have the same id."""
        n, length, postings, ids = d.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count_distinct("id")).first()
        return n, length, postings, n == ids

    def build(self, docs: DataFrame, text: str = "text") -> None:
        """Anew, from docs(id, text); an id counts once."""
        self.clear()
        self.add(docs, text)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Documents that aren't in the index, or were removed from it."""
        number, d = self._next(), cut(self._parted(docs, text))
        n, length, postings, alone = self._size(d)
        self._segment(number, d, postings, lambda place: self._each(self._unpacked(place(self._packed(d))), alone))
        self._note([(number, n, length)])
        if sum(r.docs >= 0 for r in self.segments()) > SEGMENTS:
            self.merge()

    def remove(self, docs: DataFrame, text: str = "text") -> None:
        """docs(id, text), with the texts that were indexed."""
        number, d = self._next(), cut(self._parted(docs, text))
        n, length, _, alone = self._size(d)
        ids = d.select("id", F.lit(number).cast("long").alias("before"))
        terms = self._each(d, alone).groupBy("term").agg(F.count("*").alias("df"))
        for what, rows, key in (("gone", ids, "id"), ("lost", terms, "term")):
            t = self._table(what)
            if self.store.exists(t):
                old = self.store.read(t)
                rows = cut(old.union(rows).groupBy(key).agg((F.max("before") if what == "gone" else F.sum("df")).alias(rows.columns[1])))
            self.store.replace(t, rows, key)
        self._note([(number, -n, -length)])

    def merge(self) -> None:
        """One segment with what is left of all."""
        known = self.segments()
        number, n, length = self._next(), sum(r.docs for r in known), sum(r.length for r in known)
        each = self._live(self._blocks(None)).select("term", "id", "tf", "len")
        self._segment(number, each.select("id", "len").distinct(), self._blocks(None).agg(F.sum("n")).first()[0] or 0, lambda place: place(each))
        self._note([(number, n, length)], fresh=True)
        old = [self._table(f"s{r.segment}") for r in known if r.docs >= 0]
        self.store.clear([t for t in (*old, self._table("gone"), self._table("lost")) if self.store.exists(t)])

    def clear(self) -> None:
        self.store.clear([t for t in self.store.names() if t.startswith(f"{self.name}.")])

    # --- reading ---

    def _blocks(self, terms: DataFrame | None) -> DataFrame:
        """Blocks of all segments, with their segment; of terms(term) only, where given."""
        out = []
        for r in self.segments():
            if r.docs >= 0:
                t = self._table(f"s{r.segment}")
                rows = self.store.read(t) if terms is None else self.store.lookup(t, terms)
                out.append(rows.withColumn("segment", F.lit(r.segment).cast("long")))
        return reduce(DataFrame.unionByName, out) if out else self.store.spark.createDataFrame([], _BLOCK + ", segment long")

    def _live(self, blocks: DataFrame) -> DataFrame:
        """(..., id, tf, len) of the documents in blocks that weren't removed after they were added."""
        each = blocks.withColumn("p", F.explode(F.arrays_zip("ids", "tfs", "lens"))).drop("ids", "tfs", "lens")
        each = each.select(*[c for c in each.columns if c != "p"], F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        if not self.store.exists(self._table("gone")):
            return each
        gone = self.store.read(self._table("gone"))
        return each.alias("e").join(gone.alias("g"), (F.col("e.id") == F.col("g.id")) & (F.col("e.segment") < F.col("g.before")), "left_anti")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of terms(term), from the heads of their blocks."""
        df = self._blocks(terms).select("term", F.col("n").alias("df"))
        if self.store.exists(self._table("lost")):
            df = df.union(self.store.lookup(self._table("lost"), terms).select("term", -F.col("df")))
        return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, asked: DataFrame, k: int, only: DataFrame | None = None, opened: list | None = None) -> DataFrame:
        """(query_id, id, score): the k best documents by BM25 for asked(query_id, term), ties to the smaller id. only(query_id, id):
        the documents that each query may find; weights of terms are those of the whole index. opened gets the shards with a
        term of a query, and those of them that were scored."""
        known = self.segments()
        n, length = sum(r.docs for r in known), sum(r.length for r in known)
        asked = asked.select("query_id", "term").where("term is not null").distinct()
        if n <= 0:
            return asked.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score")).limit(0)
        asked, average = cut(asked), max(length, 1) / n
        terms = asked.select("term").distinct()
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = asked.join(self.frequencies(terms).select("term", idf.alias("idf")), "term")
        blocks = self._blocks(terms)
        part = lambda tf, size: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
        reach = asked.join(blocks.select("term", "segment", "shard", "max_tf", "min_len"), "term")
        reach = reach.groupBy("query_id", "segment", "shard").agg((F.sum(part(F.col("max_tf"), F.col("min_len"))) * (1 + 1e-9)).alias("bound"))

        def scored(shards: DataFrame) -> DataFrame:
            """The scores of the documents in shards(query_id, segment, shard)."""
            hit = self._live(asked.join(shards, "query_id").join(blocks.drop("n", "max_tf", "min_len"), ["term", "segment", "shard"]))
            hit = hit if only is None else hit.join(only.select("query_id", F.col("id").cast("string").alias("id")).distinct(), ["query_id", "id"], "left_semi")
            return hit.groupBy("query_id", "id").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("score"))

        best = lambda df: top_per(df, ["query_id"], [F.desc("score"), F.col("id")], k)
        if only is not None:  # a bound says little where most of a shard may not be found
            return best(scored(reach.select("query_id", "segment", "shard"))).select("query_id", "id", "score")
        reach = cut(reach)
        first = cut(top_per(reach, ["query_id"], [F.desc("bound"), F.col("segment"), F.col("shard")], self.first).select("query_id", "segment", "shard"))
        found = cut(best(scored(first)).select("query_id", "id", "score", "rank"))
        least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = reach.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        rest = cut(rest.select("query_id", "segment", "shard").join(first, ["query_id", "segment", "shard"], "left_anti"))
        if opened is not None:
            opened += [reach.count(), first.count() + rest.count()]
        return best(found.drop("rank").union(scored(rest).select("query_id", "id", "score"))).select("query_id", "id", "score")
