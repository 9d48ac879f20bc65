"""Phrase collocation mining: weighted n-gram counts of distinct pieces, in DuckDB per hash bucket.

Method. Texts are cut at punctuation into pieces; equal pieces of a language become one with a multiplicity, by partial sums.
The n-grams of distinct pieces, weighted by that, are summed within a task and go packed to hash buckets by Spark's shuffle; in each
bucket DuckDB counts them out of core. Only n-grams that reach the least count are kept: parts of a phrase occur at least as
often as the phrase, so every count that a score needs is among them. Candidates lie in parts by the hash of the phrase; a part
sends one request for each distinct first part or rest that its phrases have, wherever how many of them share it, to where
that one is counted, and gets the count back; longer candidates tell the phrases inside them how often they occur. So no
key makes a join large: a word gets at most as many requests as there are parts. DuckDB then scores each part with 128-bit
integers and keeps its first rows of each language, from which Spark takes the first of all.

Bounded memory. A DuckDB in a task has MEMORY to work in and spills beyond it into a folder of that task, which goes with it.

Cases. Null and empty texts have no pieces; a null language is `und` and one with it. Words are parted by spaces and tabs alone,
so other white space is part of words. Repeated rows count as often as they occur. Counts are of whole texts, however long; ids
aren't used, and further columns, whatever their names, neither. An empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import itertools
import math
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, chunks, in_arrow

LEAST, LONGEST, TOP, COVERED = 10, 3, 2000, 50
#: What a DuckDB within a task works in, bytes of pieces whose n-grams are summed before they are sent, and candidates of one part.
MEMORY, GATHERED, PART = "192MB", 8 << 20, 250_000
#: Characters of text whose n-grams make up one hash bucket, and how many buckets a task sends to at once at most: beyond, n-grams go
#: to the square root of their number first and from there to each, so that what is packed together stays large.
BUCKET, FAN = 4_000_000, 1024


@contextlib.contextmanager
def database() -> Iterator[duckdb.DuckDBPyConnection]:
    """A DuckDB of this task, with one thread; what it spills is removed with it."""
    with tempfile.TemporaryDirectory(prefix="duckdb-") as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
        yield con


def _reader(first: pa.RecordBatch, batches) -> pa.RecordBatchReader:
    def all_of():
        yield first
        yield from batches

    return pa.RecordBatchReader.from_batches(first.schema, all_of())


def _pieces(batches):
    """(lang, piece, m): the distinct pieces of each chunk of texts, words joined by one space. Batches: text, lang."""
    for batch in batches:
        langs = pc.fill_null(batch.column(1), "und")
        for first, _, off in chunks(batch.column(0)):
            texts = pc.ascii_lower(pc.fill_null(batch.column(0).slice(first, len(off) - 1), ""))
            lists = pc.split_pattern_regex(texts, r"[.,;:!?\x0A-\x0D]")
            lang = langs.slice(first, len(texts)).take(pc.list_parent_indices(lists))
            piece = pc.utf8_trim(pc.replace_substring_regex(pc.list_flatten(lists), r"[ \t]+", " "), " ")
            some = pc.not_equal(piece, "")
            t = pa.table({"lang": lang.filter(some), "piece": piece.filter(some)}).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            yield from t.select(["lang", "piece", "count_all"]).rename_columns(["lang", "piece", "m"]).cast(_PIECE).to_batches(max_chunksize=65536)


_PIECE = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("m", pa.int64())])
_GRAM = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _sent(found: pa.Table):
    """(part, grams): the rows of each part, packed; found is sorted by part."""
    part = found["part"].to_numpy()
    grams = found.drop_columns(["part"]).combine_chunks()
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
        if i < j:
            sink = pa.BufferOutputStream()
            x = grams.slice(i, j - i)
            with pa.ipc.new_stream(sink, x.schema, options=_PACKED) as out:
                out.write_table(x, max_chunksize=65536)
            yield pa.record_batch({"part": pa.array([part[i]], pa.int32()), "grams": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


def _parted(con, name: str, sql: str, parts: int, width: int, rows):
    """Sums of the grams that sql gives from each of some tables, sent to the parts of their hashes, `width` to one."""
    for table in rows:
        con.register(name, table)
        yield from _sent(con.sql(f"SELECT ((hash(lang, phrase) % {parts}) // {width})::INT AS part, lang, phrase, sum(f)::BIGINT AS f FROM ({sql}) GROUP BY ALL ORDER BY part, lang, phrase").to_arrow_table())


def _gathered(batches, limit: int):
    """Tables of consecutive batches, of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 16384):
            part = batch.slice(at, 16384)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _ngrams(batches, longest: int, parts: int, width: int):
    """The n-grams of distinct pieces, with their weights summed; the empty phrase has the number of words."""
    grams = ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: {" || ' ' || ".join(f'w[i + {j}]' if j else 'w[i]' for j in range(n))})" for n in range(2, longest + 1))
    sql = f"""
        WITH p AS (SELECT lang, m, string_split(piece, ' ') AS w FROM pieces)
        SELECT lang, m AS f, unnest(flatten([w, {grams}])) AS phrase FROM p UNION ALL SELECT lang, m * len(w), '' FROM p"""
    with database() as con:
        yield from _parted(con, "pieces", sql, parts, width, _gathered(batches, GATHERED))


def _rows(batches):
    """(part, packed grams) of a task's rows, sorted by part."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _opened(rows):
    for _, x in rows:
        with pa.ipc.open_stream(x) as grams:
            yield from grams


def _resent(batches, parts: int):
    """What came to some parts together, sent on to each."""
    with database() as con:
        yield from _parted(con, "grams", "SELECT * FROM grams", parts, 1, _gathered(_opened(_rows(batches)), 4 * GATHERED))


def _count(batches, least: int):
    """Counts of the n-grams of each hash bucket that reach the least count, and the numbers of words."""
    for _, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        with database() as con:
            con.register("grams", pa.RecordBatchReader.from_batches(_GRAM, (b.cast(_GRAM) for b in _opened(rows))))
            sql = f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least} OR phrase = ''"
            for b in con.sql(sql).to_arrow_reader(65536):
                yield b.cast(_GRAM)


#: Rows that meet in a part: candidates, counts of parts of them, counts of the longer candidates that hold them.
CANDIDATE, ANSWER, LONGER = range(3)
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])


def _scored(batches, top: int, covered: int):
    """The first candidates of each language among the parts of one task. Batches: part, kind, lang, phrase, v."""
    sql = f"""
        WITH c AS (SELECT part, lang, phrase, v AS a, string_split(phrase, ' ') AS w FROM t WHERE kind = {CANDIDATE}),
        answers AS (SELECT part, lang, phrase, v FROM t WHERE kind = {ANSWER}),
        cuts AS (SELECT part, lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
        parted AS (SELECT x.*, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM cuts x),
        scores AS (
            SELECT b.part, b.lang, b.phrase, b.a, k, h.v AS l, q.v AS r, (1000000::HUGEINT * b.a * b.a) // (h.v::HUGEINT * q.v) AS score
            FROM parted b JOIN answers h ON h.part = b.part AND h.lang = b.lang AND h.phrase = b.head
            JOIN answers q ON q.part = b.part AND q.lang = b.lang AND q.phrase = b.tail),
        longer AS (SELECT part, lang, phrase, max(v) AS v FROM t WHERE kind = {LONGER} GROUP BY ALL),
        lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY part, lang, phrase ORDER BY score, k) = 1)
        SELECT lang, phrase, a, l, r, score::BIGINT AS score
        FROM lowest ANTI JOIN (SELECT y.part, y.lang, y.phrase FROM longer y JOIN c USING (part, lang, phrase) WHERE 100::HUGEINT * y.v >= {covered}::HUGEINT * c.a) gone USING (part, lang, phrase)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
    for first in batches:
        with database() as con:
            con.execute("CREATE TABLE t (part INTEGER, kind INTEGER, lang VARCHAR, phrase VARCHAR, v BIGINT)")
            con.register("rows", _reader(first, batches))
            con.execute("INSERT INTO t SELECT * FROM rows")
            for b in con.sql(sql).to_arrow_reader(65536):
                yield b.cast(_FOUND)


def _inside(phrase, n: int):
    """The phrases of two words or more that lie inside one of n words."""
    w = F.split(phrase, " ")
    return F.array(*[F.array_join(F.slice(w, i + 1, k), " ") for k in range(2, n) for i in range(n - k + 1)])


def counts(scratch: Scratch, docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, fan: int = FAN) -> DataFrame:
    """(lang, phrase, f): how often each n-gram of up to `longest` words occurs within pieces, of those that reach `least`; for
    the empty phrase, the number of words of the language."""
    d = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    size = d.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(8, -(-size // BUCKET))
    width = math.isqrt(parts) if parts > fan else 1
    pieces = d.transform(in_arrow, _pieces, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))
    grams = pieces.transform(in_arrow, lambda b: _ngrams(b, longest, parts, width), "part int, grams binary")
    if width > 1:
        grams = grams.repartition(-(-parts // width), "part").transform(in_arrow, lambda b: _resent(b, parts), "part int, grams binary")
    grams = grams.repartition(parts, "part").sortWithinPartitions("part")
    return scratch.table(grams.transform(in_arrow, lambda b: _count(b, least), "lang string, phrase string, f long"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED, fan: int = FAN
) -> DataFrame:
    """The first `top` phrases of two to `longest` words of each language: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "collocations")
    known = counts(scratch, docs, text, lang, longest, least, fan)
    words = F.size(F.split("phrase", " "))
    found = known.where("phrase <> ''").withColumn("k", words)
    parts = max(8, -(-found.where("k > 1").count() // PART))
    part = lambda lang, phrase: F.pmod(F.xxhash64(lang, phrase), F.lit(parts)).cast("int").alias("part")
    candidates = found.where("k > 1").select("lang", "phrase", "k", "f", part("lang", "phrase"))

    cut = F.explode(F.expr("transform(sequence(1, k - 1), i -> struct(slice(w, 1, i) AS h, slice(w, i + 1, k - i) AS t))"))
    cuts = candidates.withColumn("w", F.split("phrase", " ")).select("part", "lang", cut.alias("c"))
    asked = cuts.select("part", "lang", F.explode(F.array(F.array_join("c.h", " "), F.array_join("c.t", " "))).alias("phrase")).distinct()
    answers = asked.join(known, ["lang", "phrase"]).select("part", F.lit(ANSWER).alias("kind"), "lang", "phrase", F.col("f").alias("v"))
    rows = candidates.select("part", F.lit(CANDIDATE).alias("kind"), "lang", "phrase", F.col("f").alias("v")).union(answers)
    for n in range(3, longest + 1):
        inner = candidates.where(F.col("k") == n).select("lang", F.explode(_inside("phrase", n)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("v"))
        rows = rows.union(inner.select(part("lang", "phrase"), F.lit(LONGER).alias("kind"), "lang", "phrase", "v"))
    scored = rows.repartition(parts, "part").transform(in_arrow, lambda b: _scored(b, top, covered), "lang string, phrase string, a long, l long, r long, score long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = scored.withColumn("rank", place).where(F.col("rank") <= top)
    n = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = """
WITH pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
        FROM documents)),
weighted AS (SELECT lang, w, count(*) AS m FROM pieces WHERE len(w) > 0 GROUP BY ALL),
total AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM weighted GROUP BY ALL),
grams AS (
    SELECT lang, p, sum(m)::BIGINT AS f FROM (
        SELECT lang, m, unnest(flatten([list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]), list_transform(range(1, len(w) + 1), lambda i: w[i:i])])) AS p
        FROM weighted) GROUP BY ALL),
candidates AS (SELECT lang, p, f AS a FROM grams WHERE len(p) > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, len(p))) AS k FROM candidates),
scores AS (
    SELECT c.lang, c.p, c.a, c.k, h.f AS l, t.f AS r, ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN grams h ON h.lang = c.lang AND h.p = c.p[:c.k] JOIN grams t ON t.lang = c.lang AND t.p = c.p[c.k + 1:]),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, a AS v FROM candidates WHERE len(p) = 3),
gone AS (SELECT DISTINCT c.lang, c.p FROM candidates c JOIN longer y ON y.lang = c.lang AND y.p = c.p WHERE 100 * y.v >= 50 * c.a),
kept AS (SELECT x.lang, array_to_string(x.p, ' ') AS phrase, a, l, r, score FROM lowest x ANTI JOIN gone g ON g.lang = x.lang AND g.p = x.p)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
