"""Ticket ingestion: landed search rows into the warehouse, micro-batch by micro-batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ticketlens.operators.filters import timestamp
from ticketlens.plans.ingest import load_batch
from ticketlens.schemas import WAREHOUSE
from ticketlens.sources.landing import TICKET_FIELDS, read_rows, remap_search_rows
from ticketlens.sources.warehouse import Warehouse


def _utc_now() -> Column:
    moment = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return timestamp(moment)


def _first_version(warehouse: Warehouse, checkpoint: str) -> int:
    """Highest version any table had when this stream first started, kept beside the checkpoint."""
    spark, path = warehouse.spark, f"{checkpoint}_base"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        top = max((v for table in WAREHOUSE for v in warehouse.versions(table)), default=0)
        spark.createDataFrame([(top,)], "base int").coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("base int").json(path).first()["base"]


def run_ingest(
    warehouse: Warehouse,
    landing: str,
    checkpoint: str,
    now: Callable[[], Column] = _utc_now,
    dimensions: Callable[[], dict[str, DataFrame]] | None = None,
    **trigger,
) -> StreamingQuery:
    """Stream ``landing`` (JSON lines keyed by option id) into the ticket fact.

    A batch's number fixes the table version it writes, so a replay after a failure rewrites the
    same version from the same predecessor and changes nothing.
    """
    base = _first_version(warehouse, checkpoint)
    rows = read_rows(warehouse.spark, landing, TICKET_FIELDS.keys(), streaming=True)

    def apply(batch: DataFrame, number: int) -> None:
        dims = dimensions() if dimensions else {}
        load_batch(warehouse, remap_search_rows(batch), dims, now(), version=base + number + 1)

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 minutes"}))
        .start()
    )
