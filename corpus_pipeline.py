"""The corpus pipeline: five stages over `documents`, each one of the operators of loomgraph.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the shared
folder and reads it again for the next. All stages but the last return the columns of documents, further ones too, whatever
their names.

Cases, in every stage. An empty table gives an empty one. Rows without an id are compared with nothing and stay. Rows that
share an id but not a text are documents of their own; where one of several must be named, the smallest id and then the
smallest hash of the text decides. Texts are used whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, jaccard, lines, mixing, quality
from loomgraph.llm.common import Scratch

#: SQL can't express the classifier's fit or the merges of an encoder; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, fitted on the labels beside documents. A null text is an empty one and is judged by its
    site; null sources and languages are sites of their own; repeated rows share a verdict; without labels of both kinds all stay."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, an earlier document's go. A document that loses all it had goes too; n_chars is
    counted anew where a text changed. Null and empty texts have no lines and stay. Of equal lines the first by id and place
    stays; rows that repeat an earlier one whole count as one document with it."""
    done = lines.dedup(docs)
    gone = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = done.where(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; of rows with one id and one set, one.
    Documents without words (null and empty texts among them) or without an id are compared with nothing and stay."""
    return jaccard.distinct(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times. Documents without words have no size that could be mixed:
    they stay once. A null source is a source of its own, the last one. Rows that say the same are drawn together."""
    return mixing.sample(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether decoding gives the encoder's tokens again, for each document. A null or
    empty text has no ids; a document that the mix took twice is encoded twice."""
    return bpe.encode(docs, carry=["source"]).select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents in sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
