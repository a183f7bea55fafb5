"""Identifiers, canonical JSON, digests and seeds."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACE = "wayfold"


def canonical_json(value: Any, newline: bool = True) -> str:
    """Sorted keys, no spaces, non-ASCII kept, -0.0 as 0.0, sets sorted; numbers that aren't finite are refused."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("a number isn't finite")
            return 0.0 if v == 0 else v
        if isinstance(v, dict):
            if not all(isinstance(k, str) for k in v):
                raise TypeError("keys must be strings")
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, (set, frozenset)):
            return sorted((plain(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if v is None or isinstance(v, (bool, int, str)):
            return v
        raise TypeError(f"{type(v).__name__} has no canonical form")

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n" * newline


def canonical_sha256(domain: str, value: Any) -> str:
    return hashlib.sha256(f"{NAMESPACE}:{domain}:v1\n{canonical_json(value, False)}".encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical form of a column of JSON texts."""
    for s in batches:
        yield s.map(lambda t: None if t is None else canonical_json(json.loads(t), False))


def identifier(kind: str, *parts: Column) -> Column:
    """kind:part:part, trimmed."""
    return F.concat_ws(":", F.lit(kind), *[F.trim(p.cast("string")) for p in parts])


def is_identifier(value: Column) -> Column:
    """At least two non-blank parts, no control characters."""
    return value.rlike(r"^[^:\p{Cntrl}]+(:[^:\p{Cntrl}]+)+$") & ~value.rlike(r"(^|:)\s*(:|$)")


def safe_identifier(kind: str, source: Column, length: int = 16) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("|", F.lit(NAMESPACE), F.lit(kind), source.cast("string")), 256), 1, length))


def seed(root: int, *parts: Column) -> Column:
    """A non-negative 63-bit seed from a root seed and text or integer components (the first 8 bytes of a digest, top bit cleared)."""
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), p.cast("string"), F.lit('"')) for p in parts])
    digest = F.sha2(F.concat(F.lit('{"components":['), quoted, F.lit(f'],"root_seed":{root}}}')), 256)
    return F.conv(F.substring(digest, 2, 15), 16, 10).cast("long") + F.pmod(F.conv(F.substring(digest, 1, 1), 16, 10).cast("int"), F.lit(8)).cast("long") * F.lit(1 << 60)


def merged_flags(lists: Column) -> Column:
    """Order-preserving distinct union of collected string lists, trimmed, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.flatten(lists), lambda x: F.trim(x)), lambda x: x != ""))


def utc_text(t: Column) -> Column:
    """A time without zone, taken as UTC, as ISO text with microseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
