"""Table layouts of the warehouse: the enriched fact, its dimensions and the result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_TIME, _FLOAT, _BOOL = T.TimestampNTZType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


TICKETS = _table(
    id=_LONG, name=_TEXT, content=_TEXT, status=_INT, type=_INT, priority=_INT,
    itilcategories_id=_LONG, date=_TIME, date_mod=_TIME, solvedate=_TIME, closedate=_TIME,
    time_to_resolve=_TIME, user_requester=_LONG, user_assign=_LONG, entities_id=_LONG,
    groups_id_requester=_LONG, urgency=_INT, impact=_INT, is_resolved=_BOOL,
    is_high_priority=_BOOL, resolution_days=_FLOAT, name_normalized=_TEXT, loaded_at=_TIME,
)
USERS = _table(
    id=_LONG, name=_TEXT, realname=_TEXT, firstname=_TEXT, is_active=_BOOL, entities_id=_LONG,
    groups_id=_TEXT, loaded_at=_TIME,
)
ENTITIES = _table(
    id=_LONG, name=_TEXT, completename=_TEXT, entities_id=_LONG, level=_INT, loaded_at=_TIME
)
CATEGORIES = _table(
    id=_LONG, name=_TEXT, completename=_TEXT, itilcategories_id=_LONG, loaded_at=_TIME
)
GROUPS = _table(
    id=_LONG, name=_TEXT, completename=_TEXT, groups_id=_LONG, entities_id=_LONG, loaded_at=_TIME
)
KPIS = _table(
    date=T.DateType(), total_tickets=_LONG, resolved_pct=_FLOAT, high_priority_count=_LONG,
    avg_resolution_days=_FLOAT, computed_at=_TIME,
)
FOLLOWUPS = _table(
    id=_LONG, items_id=_LONG, tickets_id=_LONG, itemtype=_TEXT, content=_TEXT, date=_TIME,
    users_id=_LONG,
)
PROFILES = _table(
    user_id=_LONG, profile=_TEXT, confidence=_FLOAT,
    features_snapshot=_table(
        total_tickets=_LONG, incidents_count=_LONG, requests_count=_LONG, resolved_count=_LONG,
        open_count=_LONG, high_priority_count=_LONG, repetitive_count=_LONG,
        avg_resolution_days=_FLOAT, tickets_per_month=_FLOAT,
    ),
    computed_at=_TIME,
)
FORECASTS = _table(
    category_id=_LONG, forecast_date=T.DateType(), predicted_count=_FLOAT, lower_bound=_FLOAT,
    upper_bound=_FLOAT, confidence=_TEXT, model_version=_TEXT, computed_at=_TIME,
)
RISK = _table(
    technician_id=_LONG, risk_score=_FLOAT, next_48h_prediction=_INT, confidence=_TEXT,
    model_version=_TEXT, computed_at=_TIME,
)
CLUSTERS = _table(
    cluster_id=_LONG, algorithm=_TEXT, sample_titles=T.ArrayType(_TEXT), ticket_count=_LONG,
    top_keywords=T.ArrayType(_TEXT), severity=_TEXT, neg_ratio=_FLOAT, first_seen=_TIME,
    last_seen=_TIME, computed_at=_TIME,
)
RECOMMENDATIONS = _table(
    id=_TEXT, type=_TEXT, target_user_id=_LONG, target_group_id=_LONG, target_category_id=_LONG,
    severity=_TEXT, title=_TEXT, description=_TEXT, evidence=_TEXT, created_at=_TIME,
    expires_at=_TIME,
)
ACKS = _table(recommendation_id=_TEXT, user_id=_LONG, acknowledged_at=_TIME)


@dataclass(frozen=True)
class Table:
    """Layout, key, columns stamped on every change or on insert, and the key that is sliced.

    Tables that grow without bound are sliced; recent changes then touch few slices.
    """

    layout: T.StructType
    keys: tuple[str, ...]
    stamped: tuple[str, ...] = ()
    stamped_on_insert: tuple[str, ...] = ()
    sliced_by: str | None = None


_LOADED = ("loaded_at",)
_COMPUTED = ("computed_at",)
WAREHOUSE = {
    "dim_tickets_enriched": Table(TICKETS, ("id",), (), _LOADED, sliced_by="id"),
    "dim_users": Table(USERS, ("id",), (), _LOADED, sliced_by="id"),
    "dim_entities": Table(ENTITIES, ("id",), (), _LOADED),
    "dim_categories": Table(CATEGORIES, ("id",), (), _LOADED),
    "dim_groups": Table(GROUPS, ("id",), (), _LOADED),
    "fact_kpis_daily": Table(KPIS, ("date",), _COMPUTED),
    "ml_user_profiles": Table(PROFILES, ("user_id",), _COMPUTED, sliced_by="user_id"),
    "ml_forecasts": Table(FORECASTS, ("category_id", "forecast_date"), _COMPUTED),
    "ml_sla_risk": Table(RISK, ("technician_id",), _COMPUTED),
    "ml_clusters": Table(CLUSTERS, ("algorithm", "cluster_id"), _COMPUTED),
    "recommendations": Table(RECOMMENDATIONS, ("id",)),
    "recommendation_acks": Table(ACKS, ("recommendation_id", "user_id"), ("acknowledged_at",)),
}
