"""The shared dashboard filter, and free-text search over any result table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 500  # bound on every listing; small ranked results may rely on it


@dataclass(frozen=True)
class Filters:
    """Optional bounds; ``end_date`` includes its whole day."""

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    entity_id: int | None = None
    category_id: int | None = None
    limit: int = 50

    def __post_init__(self):
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be within 1..{MAX_LIMIT}")

    def column(self) -> Column:
        """Conjunction of the given bounds as plain comparisons, so scans can push them down."""
        terms = []
        if self.start_date is not None:
            terms.append(F.col("date") >= _midnight(self.start_date))
        if self.end_date is not None:
            terms.append(F.col("date") < _midnight(self.end_date + dt.timedelta(days=1)))
        if self.entity_id is not None:
            terms.append(F.col("entities_id") == F.lit(self.entity_id).cast("bigint"))
        if self.category_id is not None:
            terms.append(F.col("itilcategories_id") == F.lit(self.category_id).cast("bigint"))
        return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)

    def apply(self, tickets: DataFrame) -> DataFrame:
        return tickets.filter(self.column())


def _midnight(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def timestamp(value) -> Column:
    """A zone-free timestamp literal from a datetime or its text."""
    return F.lit(str(value)).cast("timestamp_ntz")


def table_search(
    df: DataFrame,
    query: str = "",
    columns: list[str] | None = None,
    sort_by: str | None = None,
    ascending: bool = True,
    tie: str | None = None,
    page: int = 1,
    page_size: int = 10,
) -> DataFrame:
    """Rows where any shown column contains ``query``, sorted by one column, one page of them."""
    text = query.strip().lower()
    shown = columns or df.columns
    if text:
        hits = [
            F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text) for c in shown
        ]
        df = df.filter(reduce(lambda a, b: a | b, hits))
    if sort_by is not None:
        key = F.col(sort_by)
        if dict(df.dtypes)[sort_by] == "string":
            key = F.coalesce(key, F.lit(""))
        order = [key.asc_nulls_last() if ascending else key.desc_nulls_last()]
        df = df.orderBy(*order, *([F.col(tie)] if tie else []))
    return df.offset((page - 1) * page_size).limit(page_size)
