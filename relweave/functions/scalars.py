"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(seed: int, *keys: Column) -> Column:
    """A pseudo-random sort key of non-null keys: the MD5 digest of seed:key, bytes reversed, as hex.

    Its string order is the order of the digest read as a little-endian 128-bit integer."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.array_join(F.reverse(F.regexp_extract_all(digest, F.lit("(..)"), F.lit(1))), "")


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    return shared / (left + right - shared)


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a grade at a rank from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1))


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_odds(p: Column, eps: float = 1e-12) -> Column:
    clipped = F.greatest(F.lit(eps), F.least(p, F.lit(1 - eps)))
    return F.log(clipped) - F.log1p(-clipped)


def log_probability(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12)))


def relevance_log_odds(logits: Column) -> Column:
    """One logit is itself; of two, the second less the first; any other number is an error."""
    wrong = F.raise_error(F.concat(F.lit("one or two logits, not "), F.size(logits).cast("string"))).cast("double")
    return F.when(F.size(logits) == 1, F.element_at(logits, 1)).when(F.size(logits) == 2, F.element_at(logits, 2) - F.element_at(logits, 1)).otherwise(wrong)


def seed_number(seed: int, key: Column) -> Column:
    """The first 8 bytes of the SHA-256 of seed:key as a whole number, in text."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 16), 16, 10)


def coerced(value: Column, kind: str, default: object = None) -> Column:
    """A value of another type, or the default where it is null or is none of that type."""
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def iso_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def signal_id(kind: Column, root: Column, path: Column, table: Column, column: Column) -> Column:
    """kind:root:a>b[:table.column]"""
    return F.concat(kind, F.lit(":"), root, F.lit(":"), F.concat_ws(">", path), F.coalesce(F.concat(F.lit(":"), table, F.lit("."), column), F.lit("")))


def signal_key(kind: str, path: str, table: str, column: str) -> Column:
    """kind:a>b[:table.column] of these columns, without the root."""
    return F.concat(F.col(kind), F.lit(":"), F.concat_ws(">", F.col(path)), F.coalesce(F.concat(F.lit(":"), F.col(table), F.lit("."), F.col(column)), F.lit("")))


def provenance(kind: Column, path: Column, table: Column, column: Column) -> Column:
    """What a signal rests on, whatever its path: table and column, or the sorted set of edges without direction."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))), lambda i: F.concat_ws("~", F.array_sort(F.slice(path, i, 2))))
    return F.when(kind == "attribute", F.concat(F.lit("attribute|"), table, F.lit("."), column)).otherwise(F.concat(F.lit("relationship|"), F.concat_ws(",", F.array_sort(steps))))
