"""Text functions as Columns; the few that Spark can't express are Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# Stopwords of names, openings of a reply that is no translation, scripts written without spaces.
STOPWORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()
REFUSALS = [
    "i appreciate", "i notice", "i'm sorry", "i am sorry", "i cannot", "i can't", "as an ai", "it appears", "the text you",
    "there is no text", "no text was provided",
]
DENSE = "\\u1100-\\u11ff\\u2e80-\\u2fdf\\u3000-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\ua960-\\ua97f\\uac00-\\ud7af\\uf900-\\ufaff\\uff00-\\uffef"


def _name(s: str) -> str:
    import re

    plain = unicodedata.normalize("NFKC", s).casefold()
    spaced = re.sub(r"[^\w\s]", " ", plain.replace("_", " ").replace("-", " "))
    return " ".join(spaced.split()) or plain.strip()


@pandas_udf(StringType())
def _name_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _name(x))


def normalize_name(c) -> Column:
    """STR-1. NFKC, case folded, punctuation to spaces, white space collapsed; if nothing is left, the folded original.
    ASCII names never leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(c)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+", " "))
    plain = F.when(spaced == "", F.trim(low)).otherwise(spaced)
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_name_udf(c))


@pandas_udf(StringType())
def normalize_for_grounding(s: pd.Series) -> pd.Series:
    """STR-2."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@pandas_udf(StringType())
def _names_udf(s: pd.Series) -> pd.Series:
    from functools import lru_cache

    one = lru_cache(1 << 16)(_name)  # for a batch
    return s.map(lambda x: None if x is None else "\n".join(map(one, x.split("\n"))))


def normalize_names(c) -> Column:
    """STR-1 of an array of words of letters in lower case, in their order; only arrays that hold others than ASCII leave the
    JVM, each as one text."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.array_join(c, "\n")
    plain = whole.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(F.split(_names_udf(F.when(~plain, whole)), "\n"))


def letter_words(c, least: int) -> Column:
    """Those of words() that have `least` letters or more and nothing else, found at once rather than among all words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{M}\p{N}_])\p{L}{%d,}+(?![\p{L}\p{M}\p{N}_])" % least), F.lit(0))


def words(c) -> Column:
    """Lower-case runs of letters, digits and underscores (STR-20)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def estimate_tokens(c) -> Column:
    """STR-3: the larger of the words and (dense characters + a quarter of the others); at least 1, 0 for nothing."""
    c = F.col(c) if isinstance(c, str) else c
    # Most texts have no dense character, which one look tells; replacing all others one by one takes far longer.
    dense = F.when(c.rlike(f"[{DENSE}]"), F.length(F.regexp_replace(c, f"[^{DENSE}]+", ""))).otherwise(F.lit(0))
    n = F.regexp_count(c, F.lit(r"\S+"))
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.greatest(n, dense + F.floor((F.length(c) - dense) / 4).cast("int"), F.lit(1)))


@pandas_udf(StringType())
def _cut(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else x[: int(len(x) * 0.95 * m / max(m, t))] if (t := max(len(x.split()), len(x) // 4)) > m else x for x, m in zip(s, n, strict=True)])


def truncate_to_tokens(c, n: int) -> Column:
    """STR-4: the text, cut to about n estimated tokens."""
    return _cut(c, F.lit(n))


def is_grounded(span, chunk, least: float = 0.6) -> Column:
    """STR-5, on normalised texts: nothing to test, fewer than 4 tokens, contained, or enough tokens in common."""
    tokens = F.filter(F.split(span, r"\s+"), lambda x: x != "")
    known = F.split(chunk, r"\s+")
    shared = F.size(F.filter(tokens, lambda x: F.array_contains(known, x))) / F.greatest(F.size(tokens), F.lit(1))
    empty = (F.coalesce(span, F.lit("")) == "") | (F.coalesce(chunk, F.lit("")) == "")
    return empty | (F.size(tokens) < 4) | F.contains(chunk, span) | (shared >= least)


def name_tokens(c) -> Column:
    """STR-6: distinct words of more than a character, and runs of digits."""
    return F.array_distinct(F.filter(words(c), lambda x: (F.length(x) > 1) | x.rlike("^[0-9]+$")))


def meaningful_tokens(c) -> Column:
    """STR-6: name_tokens without stopwords and digits."""
    return F.filter(name_tokens(c), lambda x: ~x.isin(STOPWORDS) & ~x.rlike("^[0-9]+$") & (F.length(x) > 1))


def acronym(c) -> Column:
    """STR-7: the first letters of two words or more, in upper case."""
    w = F.split(F.trim(c), r"\s+")
    letters = F.array_join(F.transform(w, lambda x: F.upper(F.substring(x, 1, 1))), "")
    return F.when((F.size(w) >= 2) & c.rlike(r"^[A-Za-z\s]+$"), letters)


def capitals(c) -> Column:
    """STR-7: a name's capital letters, if it has two or more."""
    up = F.regexp_replace(c, "[^A-Z]", "")
    return F.when(F.length(up) >= 2, up)


def jaccard(a, b) -> Column:
    """FUS-6 / STR-8: intersection over union of two arrays as sets; 0 for an empty union."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a, b) -> Column:
    """STR-9: the shorter's length over the longer's if it is contained, else 0."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((long > 0) & (F.contains(a, b) | F.contains(b, a)), short / long).otherwise(F.lit(0.0))


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-10: twice the matched characters over all, by longest matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def char_shingles(c, n: int = 3) -> Column:
    """STR-11: the set of n-grams of characters; a shorter text is its own."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(grams)).otherwise(F.array(c))


def coverage_tokens(c) -> Column:
    """STR-16: lower case, parted by white space, punctuation stripped from both ends."""
    bare = F.transform(F.split(F.lower(c), r"\s+"), lambda x: F.regexp_replace(x, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.filter(bare, lambda x: x != "")


def phrase_in(phrase, text) -> Column:
    """STR-17: the phrase's tokens stand together among the text's; for dense scripts, the phrase is contained."""
    joined = lambda c: F.concat(F.lit(" "), F.array_join(coverage_tokens(c), " "), F.lit(" "))
    dense = phrase.rlike(f"[{DENSE}]") & ~phrase.rlike(r"\s")
    return F.when(dense, F.contains(F.lower(text), F.lower(phrase))).otherwise((F.size(coverage_tokens(phrase)) > 0) & F.contains(joined(text), joined(phrase)))


def is_refusal(answer, question) -> Column:
    """STR-18."""
    low, out = F.lower(F.trim(answer)), F.lit(False)
    for x in REFUSALS:
        out = out | F.startswith(low, F.lit(x))
    return out & (low != F.lower(F.trim(question)))


def parse_strategy(c, names: tuple[str, ...] = ("simple", "local", "global", "drift")) -> Column:
    """STR-19: the name itself, else the first contained, else local."""
    low, out = F.lower(F.trim(c)), F.lit("local")
    for x in reversed(names):
        out = F.when(F.contains(low, F.lit(x)), x).otherwise(out)
    return F.when(low.isin(*names), low).otherwise(out)


def register(spark) -> None:
    """The text functions under SQL names (§2.17)."""
    spark.udf.register("normalize_name", _name_udf)
    spark.udf.register("sequence_ratio", sequence_ratio)
