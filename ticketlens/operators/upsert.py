"""Keyed merge of a batch into a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order_by``.

    An aggregate rather than a window: copies of one key are combined before the shuffle, so a
    key that fills a third of the batch never reaches one task as rows.
    """
    rest = [c for c in batch.columns if c not in keys]
    # the row itself is the last tie-breaker, which makes the choice total
    rank = F.struct(*[F.col(c) for c in [*order_by, *(c for c in rest if c not in order_by)]])
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def merge_snapshot(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    stamp: Sequence[str] = (),
    stamp_on_insert: Sequence[str] = (),
    now: Column | None = None,
    unique: bool = False,
) -> DataFrame:
    """Insert new keys, overwrite known ones; columns the batch lacks keep their old value.

    ``stamp`` columns take ``now`` on every touched row, ``stamp_on_insert`` columns only on
    new rows. Both sides are unique by key (``unique`` says the batch already is), so this is
    one shuffle join without row blow-up.
    """
    keys = list(keys)
    supplied = [c for c in batch.columns if c in current.columns and c not in keys]
    extra = [c for c in order_by if c not in batch.columns]
    if extra:
        raise ValueError(f"batch lacks order columns {extra}")
    once = batch if unique else latest_per_key(batch, keys, order_by)
    fresh = once.select(*keys, *supplied)
    fresh = fresh.withColumn("_fresh", F.lit(True)).alias("n")
    old = current.withColumn("_known", F.lit(True)).alias("o")
    joined = old.join(fresh, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    touched, known = F.col("n._fresh").isNotNull(), F.col("o._known").isNotNull()

    def value(c: str) -> Column:
        before = F.col(f"o.{c}")
        if c in keys:
            return F.coalesce(before, F.col(f"n.{c}"))
        if c in stamp:
            return F.when(touched, now).otherwise(before)
        if c in stamp_on_insert:
            return F.when(known, before).otherwise(now)
        if c in supplied:
            return F.when(touched, F.col(f"n.{c}")).otherwise(before)
        return before

    return joined.select(*[value(c).alias(c) for c in current.columns])


def replace_by(
    current: DataFrame, batch: DataFrame, column: str, values: Sequence | None = None
) -> DataFrame:
    """Drop every old row whose ``column`` value the batch carries, then add the batch.

    Use it for results that are recomputed whole per algorithm: rows that vanished do not stay.
    ``values`` names what was recomputed, so that a batch without rows clears it too.
    """
    if values is None:
        kept = current.join(batch.select(column).distinct(), column, "left_anti")
    else:
        kept = current.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    return kept.select(*current.columns).unionByName(batch, allowMissingColumns=True)
