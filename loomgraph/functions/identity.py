"""Hashes and stable ids (STR-22)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of this engine's ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "loomgraph")


def content_hash(c, length: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, length)


def stable_id(c) -> Column:
    """UUID version 5 of a text, in the JVM: SHA-1 of namespace and name, with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(c, "utf-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def entity_id(name) -> Column:
    return stable_id(F.lower(F.concat(F.lit("entity:"), name)))


def relationship_id(source, target, kind) -> Column:
    return stable_id(F.lower(F.concat(F.lit("relationship:"), source, F.lit(":"), target, F.lit(":"), kind)))


def claim_id(subject, object_, kind) -> Column:
    return stable_id(F.lower(F.concat(F.lit("claim:"), subject, F.lit(":"), F.coalesce(object_, F.lit("")), F.lit(":"), kind)))


def text_unit_id(document, number) -> Column:
    return stable_id(F.concat(F.lit("text_unit:"), document, F.lit(":"), number.cast("string")))


def packed(id) -> Column:
    """An id of stable_id as 16 bytes, which have the order of the texts; none where it is empty."""
    return F.unhex(F.replace(id, F.lit("-"), F.lit("")))


def unpacked(b) -> Column:
    """What packed() was given."""
    h = F.lower(F.hex(b))
    return F.when(F.length(b) == 0, "").otherwise(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def path_id(path) -> Column:
    """A document's id across runs: of its path with forward slashes and no leading ./"""
    return content_hash(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""), 32)


def result_key(source, content) -> Column:
    """What makes two retrieved results the same one."""
    return F.concat(F.coalesce(source, F.lit("unknown")), F.lit("-"), content_hash(content))


def check_suffix(suffix: str) -> str:
    """FLT-13: names of tenants, on the driver."""
    import re

    if not re.fullmatch(r"[a-z0-9_-]+", suffix):
        raise ValueError(f"not a suffix: {suffix!r}")
    return suffix
