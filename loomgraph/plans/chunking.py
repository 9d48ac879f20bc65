"""Splitting documents into text units (STR-12..15)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """STR-12: parts of at most `size` characters, cut at the first separator that occurs, with `overlap` characters of whole
    pieces carried over; a piece that is too long is cut by the next separator."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    if sep == "":
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]
    out, now, length = [], [], 0

    def close():
        nonlocal now, length
        joined = sep.join(now).strip()
        if joined:
            out.append(joined)
        while now and (length > overlap):
            length -= len(now.pop(0)) + len(sep)

    for piece in text.split(sep):
        if len(piece) > size:
            close()
            now, length = [], 0
            out += split_recursive(piece, size, overlap, separators[separators.index(sep) + 1 :])
            continue
        if now and length + len(piece) > size:
            close()
            while now and length + len(piece) > size:
                length -= len(now.pop(0)) + len(sep)
        now.append(piece)
        length += len(piece) + len(sep)
    joined = sep.join(now).strip()
    if joined and (not out or not out[-1].endswith(joined)):
        out.append(joined)
    return out


def merge_small(parts: list[str], least: int, most: int, sep: str = "\n") -> list[str]:
    """STR-13: short parts are joined with the next while the sum fits; a short last one with the one before."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) < least and len(out[-1]) + len(sep) + len(p) <= most:
            out[-1] += sep + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(sep) + len(out[-1]) <= most:
        out[-2:] = [out[-2] + sep + out[-1]]
    return out


def split_at_lines(text: str, lines: list[int], tolerance: float = 0.1) -> list[str] | None:
    """STR-14: cut before the given lines, counted from 1; None if more than a tenth of them don't exist."""
    rows = text.split("\n")
    ok = sorted({n for n in lines if 1 < n <= len(rows)})
    if lines and 1 - len([n for n in lines if 1 <= n <= len(rows)]) / len(lines) > tolerance:
        return None
    ends = [0, *(n - 1 for n in ok), len(rows)]
    return [p for a, b in zip(ends, ends[1:], strict=False) if (p := "\n".join(rows[a:b])).strip()]


def split_at_headers(text: str, size: int, overlap: int, least: int, html: bool = False) -> list[str]:
    """STR-15: sections by headings of levels 1 to 3, short ones merged, long ones split."""
    if html:
        text = re.sub(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>", lambda m: "\n" + "#" * int(m[1]) + " " + m[2].strip() + "\n", text)
        text = re.sub(r"<[^>]+>", " ", text)
    parts = [p.strip() for p in re.split(r"(?m)^(?=#{1,3} )", text) if p.strip()]
    return [q for p in merge_small(parts, least, size) for q in split_recursive(p, size, overlap)]


def headings(text: str) -> list[int]:
    """LLM-6, offline: boundaries are lines after a blank one that look like a heading or start a paragraph."""
    rows = text.split("\n")
    return [i + 1 for i in range(1, len(rows)) if rows[i].strip() and not rows[i - 1].strip()]


def chunk(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 100, least: int = 100, how: str = "recursive") -> DataFrame:
    """text_units(document_id, number, text), numbers from 1. how: recursive, headers, html or boundaries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for i, t in zip(df["document_id"], df["text"], strict=True):
                t = t or ""
                if how in ("headers", "html"):
                    parts = split_at_headers(t, size, overlap, least, how == "html")
                elif how == "boundaries":
                    parts = [q for p in split_at_lines(t, headings(t)) or [t] for q in split_recursive(p, size, overlap)]
                else:
                    parts = split_recursive(t, size, overlap)
                rows += [(i, n, p) for n, p in enumerate(merge_small(parts, least, size), 1)]
            yield pd.DataFrame(rows, columns=["document_id", "number", "text"])

    d = docs.select(F.col(id).cast("string").alias("document_id"), F.col(text).alias("text"))
    return d.mapInPandas(run, "document_id string, number int, text string")


def windows(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 600) -> DataFrame:
    """Text units of fixed width, in the JVM."""
    d = docs.select(F.col(id).alias("document_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = F.greatest(F.lit(0), F.ceil(F.length("t") / size).cast("int") - 1)
    d = d.select("document_id", "t", F.explode(F.sequence(F.lit(0), n)).alias("number"))
    return d.select("document_id", "number", F.substr("t", F.col("number") * size + 1, F.lit(size)).alias("text"))
