"""Stable identifiers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def reco_id(kind: Column, user: Column, group: Column, category: Column, *extra: Column) -> Column:
    """Twenty hex digits of the SHA-1 over type and targets; a missing target reads "None"."""
    raw = F.concat_ws("|", kind, _part(user), _part(group), _part(category), *map(_part, extra))
    return F.substring(F.sha1(raw), 1, 20)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and an order-insensitive hash of the contents.

    Row hashes are summed, not xor-ed, so that equal rows do not cancel out.
    """
    columns = [F.col(f"`{name}`") for name in sorted(df.columns)]
    row_hash = F.xxhash64(*columns).cast("decimal(38,0)")
    total = F.coalesce(F.sum(row_hash), F.lit(0).cast("decimal(38,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total.cast("string")), 256).alias(
            "fingerprint"
        ),
    )
