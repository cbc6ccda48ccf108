"""Find tickets without a requester and impute one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Link type of a requester, name prefix of technician pools.
REQUESTER_LINK = 1
POOL_PREFIX = "IT -"
SLICES = 256


def missing_requester(
    tickets: DataFrame, group_links: DataFrame, user_links: DataFrame
) -> DataFrame:
    """Tickets lacking a requester group or user link, and which of the two they lack.

    Links are reduced to one row per ticket before the joins, so repeated links cannot
    multiply tickets.
    """

    def linked(links: DataFrame, flag: str) -> DataFrame:
        only = links.filter(F.col("type") == REQUESTER_LINK).select(F.col("tickets_id").alias("id"))
        return only.distinct().withColumn(flag, F.lit(True))

    rows = (
        tickets.select("id")
        .join(linked(group_links, "_g"), "id", "left")
        .join(linked(user_links, "_u"), "id", "left")
    )
    return rows.select(
        "id", F.col("_g").isNull().alias("needs_group"), F.col("_u").isNull().alias("needs_user")
    ).filter(F.col("needs_group") | F.col("needs_user"))


def dept_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(user, group, group name) for every group that is not a technician pool."""
    depts = groups.filter(~F.coalesce(F.col("name"), F.lit("")).startswith(POOL_PREFIX))
    return members.filter(F.coalesce(F.col("users_id"), F.lit(0)) != 0).join(
        depts.select(F.col("id").alias("groups_id"), F.col("name").alias("group_name")), "groups_id"
    ).select("users_id", "groups_id", "group_name")


def draw(id_col: Column, seed: int, n: Column) -> Column:
    """Pseudo-random number below ``n`` that depends on id and seed only; NULL if ``n`` is 0."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.nullif(n, F.lit(0)))


def assign_requester(missing: DataFrame, candidates: DataFrame, seed: int = 42) -> DataFrame:
    """Give every incomplete ticket one candidate; group and user come from the same one.

    Candidates are numbered slice by slice (user id modulo ``SLICES``): each slice is ordered by
    its own task and only the slice sizes are summed globally. Without candidates no ticket is
    assigned.
    """
    sliced = candidates.withColumn("_slice", F.pmod(F.col("users_id"), F.lit(SLICES)))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_slice").orderBy("users_id", "groups_id")
    numbered = (
        sliced.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(starts), "_slice")  # one row per slice
        .select("users_id", "groups_id", "group_name",
                (F.col("_start") + F.col("_row") - 1).alias("_pick"))
    )
    total = candidates.agg(F.count(F.lit(1))).scalar()
    picked = missing.withColumn("_pick", draw(F.col("id"), seed, total)).join(numbered, "_pick")
    return picked.select(
        F.col("id").alias("tickets_id"),
        F.when(F.col("needs_group"), F.col("groups_id")).alias("groups_id"),
        F.when(F.col("needs_group"), F.col("group_name")).alias("group_name"),
        F.when(F.col("needs_user"), F.col("users_id")).alias("users_id"),
    )


def assignment_totals(assigned: DataFrame) -> DataFrame:
    return (
        assigned.filter(F.col("groups_id").isNotNull())
        .groupBy("group_name")
        .agg(F.count(F.lit(1)).alias("n_tickets"))
    )
