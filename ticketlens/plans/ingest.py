"""One ingestion batch: dimensions first, then tickets, then the day's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import cleaning
from ticketlens.operators import resolve, rollups, shaping
from ticketlens.sources.landing import DIMENSION_FIELDS, slim
from ticketlens.sources.warehouse import Warehouse


def rejects_path(warehouse: Warehouse, table: str, version: int) -> str:
    return f"{warehouse.root}/rejects/{table}/version={version}"


def _reject(warehouse: Warehouse, table: str, raw: DataFrame, number: Column, version: int) -> int:
    """Keep rows whose id gives no ``number`` as landed, one JSON record each; their count.

    The folder belongs to the version that left them out, so a replay rewrites it.
    """
    unread = raw.filter(number.isNull())
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns]))
    path = rejects_path(warehouse, table, version)
    unread.select(record.alias("record")).write.mode("overwrite").parquet(path)
    return warehouse.spark.read.schema("record string").parquet(path).count()


def load_dimensions(
    warehouse: Warehouse, landed: dict[str, DataFrame], now: Column, version: int | None = None
) -> dict[str, int]:
    """Merge the landed dimensions; the number of rows without a readable id per table."""
    rejected = {}
    for table, rows in landed.items():
        slimmed = slim(rows, DIMENSION_FIELDS[table])
        typed = shaping.type_dimension(slimmed, table)
        done = warehouse.upsert(table, typed.filter(F.col("id").isNotNull()), now, version=version)
        number = cleaning.whole_number(cleaning.flatten_cell(F.col("id").cast("string")))
        rejected[table] = _reject(warehouse, table, slimmed, number, done)
    return rejected


def load_batch(
    warehouse: Warehouse,
    raw_tickets: DataFrame,
    landed_dims: dict[str, DataFrame],
    now: Column,
    version: int | None = None,
) -> dict[str, int]:
    """Names resolve against the dimensions, hence their place before the tickets.

    The newest ``date_mod`` wins when the batch lists a ticket twice. Returns the number of
    rows per table that were set aside because their id could not be read.
    """
    rejected = load_dimensions(warehouse, landed_dims, now, version)
    enriched = shaping.enrich(raw_tickets).filter(F.col("id").isNotNull())
    dims = {table: warehouse.read(table) for table in set(resolve.TARGETS.values())}
    tickets = resolve.resolve_display_names(enriched, dims)
    done = warehouse.upsert("dim_tickets_enriched", tickets, now, order_by=("date_mod",), version=version)
    cell = F.col("id").cast("string") if "id" in raw_tickets.columns else F.lit(None).cast("string")
    rejected["dim_tickets_enriched"] = _reject(
        warehouse, "dim_tickets_enriched", raw_tickets, cleaning.whole_number(cell), done
    )
    # figures describe the whole fact after the merge, not only this batch
    whole = warehouse.read("dim_tickets_enriched")
    figures = rollups.kpi_snapshot(whole).withColumn("date", now.cast("date"))
    warehouse.upsert("fact_kpis_daily", figures, now, version=version)
    return rejected
