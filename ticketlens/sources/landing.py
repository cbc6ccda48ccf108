"""Landed search rows and dimension rows (JSON lines) as typed-at-the-edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numeric search option -> raw ticket field.
TICKET_FIELDS = {
    2: "id", 1: "name", 21: "content", 12: "status", 14: "type", 3: "priority",
    7: "itilcategories_id", 15: "date", 19: "date_mod", 17: "solvedate", 16: "closedate",
    18: "time_to_resolve", 4: "_users_id_requester", 5: "_users_id_assign", 80: "entities_id",
    71: "_groups_id_requester", 10: "urgency", 11: "impact",
}
# The fields kept of each landed dimension.
DIMENSION_FIELDS = {
    "dim_users": (
        "id", "name", "realname", "firstname", "is_active", "entities_id", "groups_id",
    ),
    "dim_entities": ("id", "name", "completename", "entities_id", "level"),
    "dim_categories": ("id", "name", "completename", "itilcategories_id"),
    "dim_groups": ("id", "name", "completename", "groups_id", "entities_id"),
}
FOLLOWUP_FIELDS = (
    "id", "items_id", "tickets_id", "itemtype", "content", "date", "users_id",
)


def text_schema(fields) -> T.StructType:
    """All cells as text: the JSON reader then keeps list and object cells as raw JSON."""
    return T.StructType([T.StructField(str(f), T.StringType(), True) for f in fields])


def read_rows(spark: SparkSession, path: str, fields, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(text_schema(fields)).json(path)


def _text_or_null(df: DataFrame, name: str):
    if name in df.columns:
        return F.col(f"`{name}`").cast("string")
    return F.lit(None).cast("string")


def remap_search_rows(df: DataFrame, fields: dict[int, str] | None = None) -> DataFrame:
    """Option-id columns to named columns; an option the page does not carry is NULL."""
    fields = TICKET_FIELDS if fields is None else fields
    return df.select(*[_text_or_null(df, str(opt)).alias(name) for opt, name in fields.items()])


def slim(df: DataFrame, fields) -> DataFrame:
    """Keep exactly ``fields``; missing ones become NULL."""
    return df.select(*[_text_or_null(df, name).alias(name) for name in fields])


def normalize_followups(df: DataFrame) -> DataFrame:
    """Seven columns; a follow-up without ticket id takes its item id when the item is a ticket."""
    rows = slim(df, FOLLOWUP_FIELDS)
    no_ticket = F.coalesce(F.col("tickets_id"), F.lit("")).isin("", "0")
    own_item = no_ticket & F.coalesce(F.col("itemtype") == "Ticket", F.lit(False))
    return rows.withColumn(
        "tickets_id", F.when(own_item, F.col("items_id")).otherwise(F.col("tickets_id"))
    )
