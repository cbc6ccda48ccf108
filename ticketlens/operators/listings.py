"""Ordered listings over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import measures as m

FORECAST_DAYS = 3


def _most_severe(df: DataFrame, then: Column, *ties: str) -> DataFrame:
    return df.orderBy(m.severity_order(F.col("severity")), then, *[F.asc_nulls_last(t) for t in ties])


def cluster_listing(clusters: DataFrame, limit: int = 50) -> DataFrame:
    return _most_severe(clusters, F.desc("ticket_count"), "cluster_id", "algorithm").limit(limit)


def sla_risk_listing(risk: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    top = risk.orderBy(F.desc_nulls_last("risk_score"), F.asc("technician_id")).limit(limit)
    side = users.select(F.col("id").alias("_u"), "name", "realname", "firstname")
    return top.join(side, F.col("technician_id") == F.col("_u"), "left").select(
        "technician_id",
        m.user_display_name(F.col("technician_id")).alias("name"),
        "risk_score", "next_48h_prediction", "confidence",
    )


def horizon_filter(forecasts: DataFrame, today: Column, days: int = FORECAST_DAYS) -> DataFrame:
    """Forecast days in [today, today + days)."""
    day = F.col("forecast_date")
    return forecasts.filter((day >= today) & (day < F.date_add(today, days)))


def forecast_listing(
    forecasts: DataFrame, categories: DataFrame, today: Column, category_id: int | None = None
) -> DataFrame:
    rows = horizon_filter(forecasts, today)
    if category_id is not None:
        rows = rows.filter(F.col("category_id") == category_id)
    side = categories.select(F.col("id").alias("_c"), F.col("name").alias("category_name"))
    return (
        rows.join(side, F.col("category_id") == F.col("_c"), "left")
        .select(
            "category_id", "category_name", "forecast_date",
            F.coalesce("predicted_count", F.lit(0.0)).alias("predicted_count"),
            "lower_bound", "upper_bound", "confidence",
        )
        .orderBy("category_id", "forecast_date")
    )


def top_alerts(recos: DataFrame, now: Column, n: int = 4) -> DataFrame:
    live = recos.filter(m.not_expired(F.col("expires_at"), now))
    return (
        _most_severe(live, F.desc_nulls_last("created_at"), "id")
        .limit(n)
        .select(
            F.col("id").alias("recommendation_id"), "severity", "type", "title", "description",
            "created_at",
        )
    )


def join_acks(recos: DataFrame, acks: DataFrame, user_id: int) -> DataFrame:
    """Flag the recommendations that ``user_id`` has acknowledged."""
    mine = (
        acks.filter(F.col("user_id") == user_id)
        .select(F.col("recommendation_id").alias("id"), F.lit(True).alias("_ack"))
        .dropDuplicates(["id"])
    )
    return recos.join(mine, "id", "left").withColumn("acknowledged", F.col("_ack").isNotNull()).drop("_ack")


def reco_listing(
    recos: DataFrame,
    acks: DataFrame,
    user_id: int,
    now: Column,
    reco_type: str | None = None,
    severity: str | None = None,
    limit: int = 50,
) -> DataFrame:
    live = recos.filter(m.not_expired(F.col("expires_at"), now))
    if reco_type is not None:
        live = live.filter(F.col("type") == reco_type)
    if severity is not None:
        live = live.filter(F.col("severity") == severity)
    # an acknowledgement neither adds nor drops rows, so the cut can come first
    top = _most_severe(live, F.desc_nulls_last("created_at"), "id").limit(limit)
    return join_acks(top, acks, user_id)


def reco_exists(recos: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of ``wanted`` that are known recommendations."""
    return wanted.select("id").join(recos.select("id"), "id", "left_semi")


def high_water(recos: DataFrame, now: Column) -> DataFrame:
    """Newest creation time, ``now`` when there is none."""
    return recos.agg(F.coalesce(F.max("created_at"), now).alias("high_water"))
