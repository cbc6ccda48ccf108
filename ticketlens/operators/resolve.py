"""Display names back to dimension ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.cleaning import normalize_display_name, whole_number
from ticketlens.session import cut_lineage

# Which dimension a ticket key points at.
TARGETS = {
    "itilcategories_id": "dim_categories",
    "entities_id": "dim_entities",
    "groups_id_requester": "dim_groups",
    "user_requester": "dim_users",
    "user_assign": "dim_users",
}
SAMPLES = 5


def _spellings(table: str, dim: DataFrame) -> list[Column]:
    """Ways one dimension row may be shown, most telling first."""
    if table == "dim_users":
        last = F.coalesce(F.col("realname"), F.lit(""))
        first = F.coalesce(F.col("firstname"), F.lit(""))
        return [
            F.concat(last, F.lit(" "), first),
            F.concat(first, F.lit(" "), last),
            F.col("name"),
        ]
    path = F.col("completename")
    leaf = F.when(path.contains(">"), F.element_at(F.split(path, ">"), -1))
    return [path, F.col("name"), leaf]


def name_keys(table: str, dim: DataFrame) -> DataFrame:
    """One row per normalised spelling: the id it stands for.

    A spelling shared by several rows goes to the best-ranked spelling, then the lowest id.
    """
    tagged = F.array(
        *[
            F.struct(F.lit(rank).alias("rank"), normalize_display_name(s).alias("key"))
            for rank, s in enumerate(_spellings(table, dim))
        ]
    )
    rows = dim.select(F.col("id").cast("bigint").alias("id"), F.explode(tagged).alias("s"))
    return (
        rows.filter(F.col("s.key").isNotNull())
        .groupBy(F.col("s.key").alias("name_key"))
        .agg(F.min(F.struct(F.col("s.rank"), F.col("id"))).alias("first"))
        .select("name_key", F.col("first.id").alias("name_id"))
    )


DICTIONARY_ROWS = 1_000_000
"""Resolved texts up to this many are broadcast; columns beyond take one shuffle join."""


def _targets(tickets: DataFrame, dims: dict[str, DataFrame]) -> list[tuple[str, str]]:
    return [
        (column, table) for column, table in TARGETS.items()
        if table in dims and column in tickets.columns and f"{column}_display" in tickets.columns
    ]


def _asked(column: str) -> Column:
    """The normalised text to look up for a missing key, else NULL."""
    return F.when(F.col(column).isNull(), normalize_display_name(F.col(f"{column}_display")))


def _dictionary(asked: DataFrame, targets: list[tuple[str, str]], dims: dict[str, DataFrame]) -> DataFrame:
    """(column, name_key, name_id) of the texts in the columns of ``asked``."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dim"), F.col(c).alias("name_key"))
        for c, t in targets
    ])
    wanted = (
        asked.select(F.explode(cells).alias("w")).select("w.*")
        .filter(F.col("name_key").isNotNull()).distinct()
    )
    spellings = None
    for table in sorted({t for _, t in targets}):
        one = name_keys(table, dims[table]).withColumn("dim", F.lit(table))
        spellings = one if spellings is None else spellings.unionByName(one)
    return wanted.join(spellings, ["dim", "name_key"]).select("column", "name_key", "name_id")


def name_dictionary(tickets: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """(column, name_key, name_id) for every distinct text the tickets need looked up.

    Lookups are gathered from the fact as distinct (column, normalised text) pairs, which
    combine before their shuffle, and meet the spellings of all dimensions in one join.
    """
    targets = _targets(tickets, dims)
    return _dictionary(tickets.select(*[_asked(c).alias(c) for c, _ in targets]), targets, dims)


def resolve_display_names(
    tickets: DataFrame, dims: dict[str, DataFrame], dictionary_rows: int = DICTIONARY_ROWS
) -> DataFrame:
    """Fill missing key ids from their shown texts; what matches no spelling stays NULL.

    The fact is read, cleaned and normalised once and kept in the shared folder; all below works
    on those files. Its distinct texts are resolved into a dictionary (see ``name_dictionary``),
    whose part for each column is counted: the smallest parts, ``dictionary_rows`` rows in all,
    are broadcast. Where parts are left, only their columns' lookups are exploded with a row
    number, meet them in one shuffle join, and come back to the fact by that number; otherwise
    the fact is never shuffled. Row count and order of columns stay as they were.
    """
    targets = _targets(tickets, dims)
    if not targets:
        return tickets
    keys = {c: f"_key_{c}" for c, _ in targets}
    out = held = cut_lineage(
        tickets.select("*", *[_asked(c).alias(k) for c, k in keys.items()])
        .withColumn("_row", F.monotonically_increasing_id())
    )
    dictionary = cut_lineage(
        _dictionary(held.select(*[F.col(k).alias(c) for c, k in keys.items()]), targets, dims)
    )
    counted = {r["column"]: r["count"] for r in dictionary.groupBy("column").count().collect()}  # one a column
    room, wide = dictionary_rows, []
    for column in sorted(keys, key=lambda c: counted.get(c, 0)):
        rows = counted.get(column, 0)
        if rows > room:
            wide.append(column)
            continue
        if not rows:
            continue
        room -= rows
        one = dictionary.filter(F.col("column") == column).select(
            F.col("name_key").alias(keys[column]), F.col("name_id").alias("_id")
        )
        out = (
            out.join(F.broadcast(one), keys[column], "left")  # its size was counted just above
            .withColumn(column, F.coalesce(F.col(column), F.col("_id"))).drop("_id")
        )
    if wide:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(keys[c]).alias("name_key")) for c in wide])
        found = (
            held.select("_row", F.explode(cells).alias("w")).select("_row", "w.*")
            .filter(F.col("name_key").isNotNull())
            .join(dictionary, ["column", "name_key"])
            .groupBy("_row").agg(*[
                F.max(F.when(F.col("column") == c, F.col("name_id"))).alias(f"_id_{c}") for c in wide
            ])
        )
        out = out.join(found, "_row", "left").withColumns(
            {c: F.coalesce(F.col(c), F.col(f"_id_{c}")) for c in wide}
        )
    return out.select(*tickets.columns)


def fk_resolution_report(resolved: DataFrame) -> DataFrame:
    """Per key column: texts that needed a lookup, how many matched, five unmatched ones."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("fk_column"),
                F.col(f"{c}_display").alias("shown"),
                F.col(c).alias("id"),
            )
            for c in TARGETS
        ]
    )
    looked_up = F.col("c.shown").isNotNull() & whole_number(F.col("c.shown")).isNull()
    texts = (
        resolved.select(F.explode(cells).alias("c"))
        .groupBy("c.fk_column", F.when(looked_up & F.col("c.id").isNull(), F.col("c.shown")).alias("unmatched_text"))
        .agg(
            F.count_if(looked_up).alias("missing"),
            F.count_if(looked_up & F.col("c.id").isNotNull()).alias("resolved"),
        )
    )
    counts = texts.groupBy("fk_column").agg(
        F.sum("missing").alias("missing"),
        F.sum("resolved").alias("resolved"),
        (F.sum("missing") - F.sum("resolved")).alias("unmatched"),
    )
    order = Window.partitionBy("fk_column").orderBy("unmatched_text")
    samples = (
        texts.filter(F.col("unmatched_text").isNotNull())
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= SAMPLES)
        .groupBy("fk_column")
        .agg(F.sort_array(F.collect_list("unmatched_text")).alias("samples"))
    )
    return counts.join(samples, "fk_column", "left")
