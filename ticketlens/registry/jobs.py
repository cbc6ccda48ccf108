"""Streams and whole jobs, run to the end over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ticketlens.operators.filters import timestamp
from ticketlens.plans import inference
from ticketlens.plans import retrain as training
from ticketlens.plans.ingest import load_dimensions
from ticketlens.registry import query
from ticketlens.registry.expressions import ENRICHED_SQL, _SHOWN, raw
from ticketlens.registry.ingestion import _MAP_OF, _MAPS, _resolved_sql
from ticketlens.registry.sql import NOW, over
from ticketlens.session import scratch_path
from ticketlens.sources import testbed as tb
from ticketlens.sources.warehouse import Warehouse
from ticketlens.streaming.alerts import alert_stream, run_alerts
from ticketlens.streaming.ingest import run_ingest

_START = "2024-01-10 00:00:00"


@query("alert_stream", over("recos", f"""
    SELECT 'alert' AS type, severity, title, description, id AS recommendation_id,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp
    FROM recos WHERE severity = 'CRITIQUE' AND created_at > TIMESTAMP '{_START}'"""))
def _(spark, sf):
    # land the rows in files, as the feed finds them
    folder, sink = scratch_path(spark, "recos"), scratch_path(spark, "alerts")
    recos = tb.recommendations(spark, sf)
    recos.write.parquet(folder)
    stream = spark.readStream.schema(recos.schema).parquet(folder)
    feed = run_alerts(
        alert_stream(stream, timestamp(_START)), sink, scratch_path(spark, "alerts-state"), availableNow=True
    )
    feed.awaitTermination()
    return spark.read.schema(alert_stream(recos.limit(0)).schema).parquet(sink)


_KEPT = ("id", "name", "status", "priority", "date", "date_mod", "is_resolved", "name_normalized", *_MAP_OF)


@query("ticket_ingest_stream", raw(
    "SELECT r.id, e.name, e.status, e.priority, e.date, e.date_mod, e.is_resolved, e.name_normalized, "
    + ", ".join(f"r.{c}" for c in _MAP_OF) + f" FROM resolved r JOIN ({ENRICHED_SQL}) e ON e.id = r.id",
    shown=_SHOWN, **_MAPS, resolved=_resolved_sql()))
def _(spark, sf):
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    dims = {
        "dim_users": tb.users(spark, sf), "dim_entities": tb.entities(spark, sf),
        "dim_categories": tb.categories(spark, sf), "dim_groups": tb.groups(spark, sf),
    }
    load_dimensions(warehouse, dims, timestamp(NOW))
    landing = scratch_path(spark, "landing")
    tb.search_rows(spark, sf).write.json(landing)
    run_ingest(
        warehouse, landing, scratch_path(spark, "ingest-state"), now=lambda: timestamp(NOW), availableNow=True
    ).awaitTermination()
    return warehouse.read("dim_tickets_enriched").select(*_KEPT)


def _table_counts(frames):
    counted = [
        rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("result_table"), "n")
        for table, rows in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


@query("ml_inference_job")
def _(spark, sf):
    """The whole scoring job into a warehouse; the row counts it left there."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    warehouse.upsert("dim_tickets_enriched", tb.tickets(spark, sf, *tb.TICKET_COLUMNS), timestamp(NOW))
    done = inference.run(spark, warehouse.root, timestamp(NOW), version="1")
    return _table_counts({table: warehouse.read(table) for table in done})


@query("retrain_job")
def _(spark, sf):
    root = scratch_path(spark, "training")
    rows = tb.tickets(spark, sf, *tb.TICKET_COLUMNS)
    training.retrain(rows, timestamp(NOW), root)
    return training.history(spark, root).select("model", "version", "metric", "value", "promoted")
