"""Seeded random numbers that any engine with MD5 can draw again."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def drawn(seed: int, *columns: str) -> Column:
    """A deterministic random number in [0, 1): the first 52 bits of the MD5 of the seed and the columns as text, joined by colons; nulls are left out."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def drawn_sql(seed: int, *columns: str) -> str:
    """The same in DuckDB."""
    text = ", ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in columns]])
    return f"(CAST(concat('0x', substr(md5(concat_ws(':', {text})), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"
