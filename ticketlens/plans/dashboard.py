"""The dashboard's answers: one lazy frame per part, all over the same filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.operators import features, listings, rollups
from ticketlens.operators.filters import Filters, timestamp
from ticketlens.sources.warehouse import Warehouse


class Dashboard:
    """Answers over a warehouse. Nothing runs until a frame is used."""

    def __init__(self, warehouse: Warehouse, now: dt.datetime):
        self._read = warehouse.read
        self._now = timestamp(now)
        self._today = F.lit(now.date().isoformat()).cast("date")

    def _tickets(self) -> DataFrame:
        return self._read("dim_tickets_enriched")

    def overview(self, f: Filters = Filters()) -> dict[str, DataFrame]:
        tickets, users = self._tickets(), self._read("dim_users")
        categories = self._read("dim_categories")
        return {
            "kpis": rollups.overview_kpis(tickets, f),
            "repetitive": rollups.repetitive_total(self._read("ml_clusters")),
            "top_category": rollups.top_category(tickets, categories, f),
            "top_sites": rollups.top_sites(tickets, self._read("dim_entities"), f),
            "top_categories": rollups.top_categories(tickets, categories, f),
            "top_requesters": rollups.top_requesters(tickets, users, f),
            "sla_by_technician": rollups.sla_by_technician(tickets, users, f),
            "alerts": listings.top_alerts(self._read("recommendations"), self._now),
        }

    def requesters(self, f: Filters = Filters(), with_repetitive: bool = True) -> DataFrame:
        tickets = self._tickets()
        repetitive = features.repetitive_titles(tickets) if with_repetitive else None
        return rollups.requester_rollup(
            tickets, self._read("dim_users"), self._read("ml_user_profiles"), f, repetitive
        )

    def services(self, f: Filters = Filters()) -> DataFrame:
        return rollups.service_rollup(self._tickets(), self._read("dim_groups"), f)

    def sites(self, f: Filters = Filters()) -> DataFrame:
        return rollups.site_rollup(self._tickets(), self._read("dim_entities"), f)

    def technicians(self, f: Filters = Filters()) -> DataFrame:
        return rollups.technician_rollup(
            self._tickets(), self._read("dim_users"), self._read("ml_sla_risk"), f
        )

    def categories(self, f: Filters = Filters()) -> DataFrame:
        return rollups.category_rollup(self._tickets(), self._read("dim_categories"), f)

    def repetitive(self, f: Filters = Filters()) -> DataFrame:
        return listings.cluster_listing(self._read("ml_clusters"), f.limit)

    def volume_forecast(self, f: Filters = Filters()) -> DataFrame:
        return listings.forecast_listing(
            self._read("ml_forecasts"), self._read("dim_categories"), self._today, f.category_id
        )

    def sla_risk(self, f: Filters = Filters()) -> DataFrame:
        return listings.sla_risk_listing(self._read("ml_sla_risk"), self._read("dim_users"), f.limit)

    def recommendations(
        self, user_id: int, reco_type: str | None = None, severity: str | None = None, limit: int = 50
    ) -> DataFrame:
        return listings.reco_listing(
            self._read("recommendations"), self._read("recommendation_acks"), user_id, self._now,
            reco_type, severity, limit,
        )
