"""Evaluation and exports for pictures (§2.18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import phrase_in, words
from loomgraph.operators.graph import cut
from loomgraph.operators.relational import metric_statistics

EVALUATORS: dict = {}


def evaluator(name: str):
    """EXT-4."""

    def add(f):
        if name in EVALUATORS:
            raise ValueError(f"{name} is registered")
        EVALUATORS[name] = f
        return f

    return add


@evaluator("coverage")
def coverage(answers: DataFrame) -> DataFrame:
    """EVL-1: (query_id, entity_coverage, relationship_coverage, overall) of answers(query_id, context, expected_entities,
    expected_relationships); NULL where nothing is expected, overall the mean of what there is."""
    share = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.size(F.filter(c, lambda x: phrase_in(x, F.col("context")))) / F.size(c))
    d = answers.select("query_id", share("expected_entities").alias("entity_coverage"), share("expected_relationships").alias("relationship_coverage"))
    both = F.filter(F.array("entity_coverage", "relationship_coverage"), lambda x: x.isNotNull())
    return d.withColumn("overall", F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both)))


#: Phrases that are sent to all tasks at most; more are joined.
SENT = 100_000


def _spaced(c) -> Column:
    """The coverage_tokens of a text with a space before, between and after, by patterns over the whole text."""
    bare = F.regexp_replace(F.lower(c), r"(?<!\S)\p{Punct}+|\p{Punct}+(?!\S)", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(" "))


def phrase_hits(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """STR-17 of all phrases(item_id, text) against all docs(doc_id, text): (item_id, doc_id). A phrase meets the documents that
    have the rarest of its words, and is looked for in these. Each text is parted once, and phrases go where it is; documents
    are shuffled only where there are more than SENT phrases."""
    p = cut(phrases.select("item_id", _spaced("text").alias("p")).where("trim(p) <> ''"))
    d = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _spaced("text").alias("x")).where("x is not null"))
    few = p.count() <= SENT
    send = F.broadcast if few else (lambda df: df)
    asked = p.select("p").distinct().select("p", F.explode(F.array_distinct(F.split(F.trim("p"), " "))).alias("t"))
    # explode_outer: for explode, the optimizer would infer a filter that parts the text a second time.
    each = lambda *c: d.select(*c, F.explode_outer(F.array_distinct(F.split(F.trim("x"), " "))).alias("t"))
    count = each().join(send(asked.select("t").distinct()), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    rarest = asked.join(count, "t", "left").groupBy("p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("r"))
    rare = cut(p.join(rarest.where("r.n > 0").select("p", F.col("r.t").alias("t")), "p"))
    if few:
        met = each("doc_id", "x").join(F.broadcast(rare), "t")
    else:
        met = each("row").join(rare, "t").select("row", "item_id", "p").join(d, "row")
    return met.where(F.contains("x", "p")).select("item_id", "doc_id")


@evaluator("overlap")
def token_f1(answers: DataFrame) -> DataFrame:
    """LLM-15, LLM-16, offline: F1 of the words of answer and truth."""
    a, b = F.array_distinct(words(F.col("answer"))), F.array_distinct(words(F.col("truth")))
    both = F.size(F.array_intersect(a, b))
    return answers.select("query_id", F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0)).alias("f1"))


def context_metadata(contexts: DataFrame) -> DataFrame:
    """EVL-2: number and mean length of each query's contexts."""
    return contexts.groupBy("query_id").agg(F.count("*").alias("contexts"), F.avg(F.length("content")).alias("mean_length"))


def summary(reports: DataFrame) -> DataFrame:
    """AGG-19: questions, answered ones, their share, and the mean of response times above zero."""
    ok = F.coalesce(F.trim("answer"), F.lit("")) != ""
    return reports.agg(F.count("*").alias("questions"), F.count_if(ok).alias("answered"), F.avg(ok.cast("double")).alias("success"), F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))).alias("mean_seconds"))


def statistics(values: DataFrame) -> DataFrame:
    """AGG-18 over values(metric, value)."""
    return metric_statistics(values, "metric", "value")


def layout(vectors: DataFrame, id: str = "id", vector: str = "embedding") -> DataFrame:
    """VIS-2: two principal components of each vector; the covariance, of the vector's size, is summed by Spark."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = vectors.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(d).transform(d).select(id, vector_to_array("p").alias("p"))
    return p.select(id, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def node_styles(degrees: DataFrame, base: float = 10.0, factor: float = 30.0) -> DataFrame:
    """VIS-3, VIS-4: the size of each node by the logarithm of its degree."""
    top = degrees.agg(F.max("degree").alias("top"))
    j = degrees.crossJoin(F.broadcast(top))  # one row
    return j.select("id", "degree", (base + factor * F.when(F.col("top") > 0, F.log1p("degree") / F.log1p("top")).otherwise(F.lit(0.0))).alias("size"))


def evaluate_each(answers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """EVL-3: (query_id, evaluator, report) of each named evaluator over answers, as JSON; a query that an evaluator has nothing
    for has an empty report."""
    out = None
    for n in names or sorted(EVALUATORS):
        got = EVALUATORS[n](answers)
        body = F.to_json(F.struct(*[c for c in got.columns if c != "query_id"])).alias("report")
        part = answers.select("query_id").distinct().join(got.select("query_id", body), "query_id", "left").select("query_id", F.lit(n).alias("evaluator"), F.coalesce("report", F.lit("{}")).alias("report"))
        out = part if out is None else out.union(part)
    return out


def scattered(vertices: DataFrame, seed: int = 0) -> DataFrame:
    """MTH-10: (id, x, y), places by a hash of the id, for a picture without a layout; within 0 and 1, the same in each run."""
    unit = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / (1 << 30))
    return vertices.select("id", unit(1).alias("x"), unit(2).alias("y"))


RENDERERS: dict = {}


def renderer(name: str):
    """EXT-3: registers a function from a DataFrame and a title to a text."""

    def add(f):
        if name in RENDERERS:
            raise ValueError(f"{name} is registered")
        RENDERERS[name] = f
        return f

    return add


@renderer("html")
def html_table(df: DataFrame, title: str, n: int = 10) -> str:
    """VIS-5, VIS-6, TOP-6: the first n rows as escaped HTML."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    rows = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in df.limit(n).collect())
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{rows}</table>"
