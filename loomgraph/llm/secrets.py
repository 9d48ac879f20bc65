"""Secret scans: base patterns, and character Markov models of random strings against ordinary identifiers.

Method. Two first-order Markov chains over characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples. A token whose log-likelihood ratio (random over ordinary) passes a threshold is a secret.
The samples are labelled by the corpus itself: values that a base pattern caught are random strings, all other long
tokens are ordinary. Transition counts are gathered over every text and summed by Spark; the models are two tables of
(65 + 1) squared numbers, whatever the size of the corpus.

Cases. A null text is an empty one; an empty text has no spans. A null id is kept as null. Repeated rows give repeated
results. Texts of any length are scanned whole; offsets are code points. With no samples of a class its chain is uniform.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import in_arrow

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_-]{8,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_N = len(ALPHABET) + 1  # the last code is a token's edge
_CODE = np.full(128, _N - 1)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def _values(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
    """The random string inside each base span."""
    for start, kind, end in spans:
        value = _ASSIGN.match(text, start, end)[1] if kind == 0 else text[start:end]
        if len(value) >= 16:
            yield value


def _outside(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    """text with the spans, which may overlap, replaced."""
    done, parts = 0, []
    for start, _, end in spans:
        if start >= done:
            parts += [text[done:start], by]
        done = max(done, end)
    return "".join(parts) + text[done:]


def transitions(tokens: list[str]) -> np.ndarray:
    """Counts of (character, next character) over tokens, flattened; tokens' edges count as a character."""
    codes = _CODE[np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("ascii", "replace"), np.uint8) & 127]
    return np.bincount(codes[:-1] * _N + codes[1:], minlength=_N * _N)


class MarkovPair:
    """Log-likelihood ratios under two chains, each smoothed with one added count for every transition."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        rates = [np.log((c := x.reshape(_N, _N) + 1.0) / c.sum(1, keepdims=True)) for x in (random, ordinary)]
        self.ratio = (rates[0] - rates[1]).ravel()

    def score(self, token: str) -> float:
        """log P(token | random) - log P(token | ordinary), without the edges."""
        codes = _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8) & 127]
        return float(self.ratio[codes[:-1] * _N + codes[1:]].sum())


def train(docs: DataFrame, text: str = "text") -> MarkovPair:
    """The two chains, from every whole text. One row of counts for each task and class is summed by Spark."""

    def count(batches):
        sums = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                spans = base_spans(x or "")
                if spans:
                    sums[0] += transitions(list(_values(x, spans)))
                    x = _outside(x, spans, " ")
                if x and (plain := _IDENTIFIER.findall(x)):
                    sums[1] += transitions(plain)
        kind, cell = np.nonzero(sums)
        yield pa.record_batch({"kind": pa.array(kind, pa.int32()), "cell": pa.array(cell, pa.int32()), "n": pa.array(sums[kind, cell], pa.int64())})

    rows = docs.select(F.col(text).alias("t")).transform(in_arrow, count, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((2, _N * _N))
    for r in rows:  # at most 2 * 67 * 67 of them
        sums[r.kind, r.cell] = r.n
    return MarkovPair(*sums)


def find(text: str, model: MarkovPair, threshold: float, per_char: float) -> tuple[list, list]:
    """The base spans, and all spans, of one text, sorted by start, then kind."""
    base = base_spans(text)
    more = []
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for m in _TOKEN.finditer(text):
        token = m[0]
        before = bisect_left(starts, m.end())  # base spans that start before its end; reach: how far they go
        if any(c.isdigit() for c in token) and not (before and reach[before - 1] > m.start()):
            s = model.score(token)
            if s >= threshold and s >= per_char * len(token):
                more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def scan(docs: DataFrame, model: MarkovPair, id: str = "doc_id", text: str = "text", threshold: float = 20.0, per_char: float = 1.0, redact: bool = False) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_markov, base_spans, spans; with redact also the text with
    each span replaced by [SECRET]. A token is a secret by the models when its log-likelihood ratio is at least
    threshold in total and per_char a character, and it has a digit."""

    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans", "redacted")}
            for x in batch.column(1).to_pylist():
                x = x or ""
                base, spans = find(x, model, threshold, per_char)
                kinds = [k for _, k, _ in spans]
                for i, c in enumerate(("n_assign", "n_access", "n_hex", "n_markov")):
                    cols[c].append(kinds.count(i))
                cols["base_spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                cols["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
                if redact:
                    cols["redacted"].append(_outside(x, spans, "[SECRET]"))
            if not redact:
                del cols["redacted"]
            yield pa.record_batch([batch.column(0), *(pa.array(v, pa.string() if k in ("base_spans", "spans", "redacted") else pa.int64()) for k, v in cols.items())], names=["id", *cols])

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_spans string, spans string" + ", redacted string" * redact
    return docs.select(F.col(id), F.col(text)).toDF("id", "text").transform(in_arrow, run, schema).withColumnRenamed("id", id)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_markov", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
