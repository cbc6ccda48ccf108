"""Raw rows to the enriched ticket fact and typed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schemas
from ticketlens.functions import cleaning, measures
from ticketlens.sources.landing import TICKET_FIELDS

# Raw field names that differ from the warehouse's.
RENAMED = {
    "_users_id_requester": "user_requester",
    "_users_id_assign": "user_assign",
    "_groups_id_requester": "groups_id_requester",
}
DATES = ("date", "date_mod", "solvedate", "closedate", "time_to_resolve")
FOREIGN_KEYS = (
    "itilcategories_id", "entities_id", "groups_id_requester", "user_requester", "user_assign",
)
# Target type of each dimension column.
DIMENSION_CASTS = {
    "dim_users": {
        "id": "int", "is_active": "bool", "entities_id": "int", "name": "str",
        "realname": "str", "firstname": "str", "groups_id": "str",
    },
    "dim_entities": {
        "id": "int", "entities_id": "int", "level": "int", "name": "str", "completename": "str",
    },
    "dim_categories": {
        "id": "int", "itilcategories_id": "int", "name": "str", "completename": "str",
    },
    "dim_groups": {
        "id": "int", "groups_id": "int", "entities_id": "int", "name": "str",
        "completename": "str",
    },
}


def conform(df: DataFrame) -> DataFrame:
    """Raw field names to warehouse names: unknown fields go, missing ones come as NULL."""
    columns = []
    for raw in TICKET_FIELDS.values():
        cell = F.col(f"`{raw}`") if raw in df.columns else F.lit(None)
        columns.append(cell.cast("string").alias(RENAMED.get(raw, raw)))
    return df.select(*columns)


def parse_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: cleaning.lenient_timestamp(F.col(c)) for c in DATES})


def coerce_foreign_keys(df: DataFrame) -> DataFrame:
    """Keep each key's shown text in ``<key>_display`` and its number, if it is one, in place."""
    shown = df.withColumns({f"{c}_display": cleaning.flatten_cell(F.col(c)) for c in FOREIGN_KEYS})
    return shown.withColumns(
        {c: cleaning.whole_number(F.col(f"{c}_display")) for c in FOREIGN_KEYS}
    )


def type_scalars(df: DataFrame) -> DataFrame:
    small = ("status", "type", "priority", "urgency", "impact")
    return df.withColumns(
        {"id": cleaning.whole_number(F.col("id"))}
        | {c: cleaning.whole_number(F.col(c)).cast("int") for c in small}
    )


def derive(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_resolved": measures.is_resolved(F.col("status")),
            "is_high_priority": measures.is_high_priority(F.col("priority")),
            "resolution_days": measures.days_between(F.col("date"), F.col("solvedate")),
            "name_normalized": cleaning.normalize_title(F.col("name")),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    """Raw rows to enriched tickets, plus one ``_display`` text per foreign key."""
    for step in (conform, parse_dates, coerce_foreign_keys, type_scalars, derive):
        df = df.transform(step)
    return df


def type_dimension(df: DataFrame, table: str) -> DataFrame:
    """Cast a landed dimension column by column; list and object texts stay as they are."""
    if table not in DIMENSION_CASTS:
        raise ValueError(f"unknown dimension {table}")
    out = []
    for name, kind in DIMENSION_CASTS[table].items():
        if name not in df.columns:
            continue
        cell = F.col(name)
        if kind == "bool":
            cell = cleaning.coerce_bool(cell)
        elif kind == "int":
            cell = cleaning.whole_number(cleaning.flatten_cell(cell.cast("string")))
        else:
            cell = cell.cast("string")
        out.append(cell.alias(name))
    return df.select(*out)


def to_records(df: DataFrame) -> DataFrame:
    """One JSON record per row: times as ``yyyy-MM-dd HH:mm:ss``, missing values as null."""
    cells = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            cell = cleaning.json_timestamp(cell)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cell = F.nanvl(cell, F.lit(None).cast("double"))
        cells.append(cell.alias(field.name))
    record = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    return df.select(record.alias("record"))


def nested_to_json(df: DataFrame, columns) -> DataFrame:
    """Lists and structs to JSON text; scalars are left alone, accents are kept."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns if c in df.columns})


def empty_tickets(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.TICKETS)
