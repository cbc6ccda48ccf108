"""Recommendation rules. Thresholds are parameters, set here to values the data reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions.ids import reco_id
from ticketlens.operators import features, forecast, models, recommend, rollups
from ticketlens.operators.filters import timestamp
from ticketlens.registry import query
from ticketlens.registry.features import (
    CONCENTRATION_SQL, SLA_INPUT, USER_INPUT, series, sla_features, user_features,
)
from ticketlens.registry.sql import NOW, over
from ticketlens.sources import testbed as tb

RULES = recommend.Rules(
    formation=recommend.Formation(incident_concentration_pct=40.0),
    automatisation=recommend.Automatisation(min_repetitive=15),
    cause_racine=recommend.CauseRacine(min_tickets=40),
)


def _id(kind: str, user="NULL", category="NULL", extra: str = "") -> str:
    def part(x):
        return f"coalesce(({x})::VARCHAR, 'None')"

    tail = f" || '|' || {part(extra)}" if extra else ""
    return f"substr(sha1('{kind}|' || {part(user)} || '|None|' || {part(category)}{tail}), 1, 20)"


def _row(kind: str, severity: str, user: str, category: str, title: str, source: str, extra: str = "") -> str:
    return f"""SELECT {_id(kind, user, category, extra)} AS id, '{kind}' AS type, CAST({user} AS BIGINT) AS target_user_id,
        CAST(NULL AS BIGINT) AS target_group_id, CAST({category} AS BIGINT) AS target_category_id,
        '{severity}' AS severity, {title} AS title FROM {source}"""


_FORMATION = _row(
    "FORMATION", "ÉLEVÉ", "p.user_id", "c.categories[1]", "'Formation ciblée pour l''utilisateur ' || p.user_id",
    f"rule_profiles p JOIN ({CONCENTRATION_SQL}) c ON c.user_id = p.user_id WHERE profile = 'critique' AND pct >= 40",
)
_AUTOMATISATION = _row(
    "AUTOMATISATION", "MODÉRÉ", "user_id", "NULL",
    "'Automatiser les demandes répétitives de l''utilisateur ' || user_id",
    "user_features WHERE repetitive_count > 15",
)
# the last three days of each series play its forecast
_SURCHARGE = _row(
    "SURCHARGE", "CRITIQUE", "NULL", "category_id", "'Surcharge prévue sur la catégorie ' || category_id",
    """(SELECT category_id, max(y) AS peak, avg(y) AS mean FROM numbered WHERE back <= 3 GROUP BY 1)
       WHERE mean > 0 AND peak > 1.5 * mean AND (SELECT avg(historical_sla_pct) FROM sla_features) < 90""",
)
_CAUSE = _row(
    "CAUSE_RACINE", "CRITIQUE", "NULL", "NULL", "'Cause racine détectée (cluster ' || cluster_id || ')'",
    f"clusters WHERE algorithm = 'dbscan' AND ticket_count >= 40 AND last_seen >= TIMESTAMP '{NOW}' - to_days(30)",
    extra="cluster_id",
)
_SHOWN = (
    "id", "type", "target_user_id", "target_group_id", "target_category_id", "severity", "title",
)


def _formation(spark, sf):
    rows = tb.tickets(spark, sf, "user_requester", "type", "itilcategories_id")
    profiles = models.rule_profiles(user_features(spark, sf))
    return recommend.formation(profiles, features.incident_concentration(rows), RULES.formation)


def _last_days(spark, sf):
    tail = forecast.holdout_split(series(spark, sf)).filter("part = 'test'")
    return tail.select("category_id", F.col("y").cast("double").alias("predicted_count"))


def _team(spark, sf):
    fallback = rollups.global_sla_pct(tb.tickets(spark, sf, "solvedate", "closedate", "time_to_resolve"))
    return features.team_sla(sla_features(spark, sf), fallback)


@query("reco_formation", over("user_features", _FORMATION))
def _(spark, sf):
    return _formation(spark, sf).select(*_SHOWN)


@query("reco_automatisation", over("user_features", _AUTOMATISATION))
def _(spark, sf):
    profiles = models.rule_profiles(user_features(spark, sf))
    return recommend.automatisation(profiles, RULES.automatisation).select(*_SHOWN)


@query("reco_surcharge", over("series sla_features", _SURCHARGE))
def _(spark, sf):
    return recommend.surcharge(_last_days(spark, sf), _team(spark, sf), RULES.surcharge).select(*_SHOWN)


@query("reco_cause_racine", over("clusters", _CAUSE))
def _(spark, sf):
    return recommend.cause_racine(tb.clusters(spark, sf), timestamp(NOW), RULES.cause_racine).select(*_SHOWN)


@query("reco_id", f"""
    SELECT event_id, {_id('FORMATION', 'user_id', 'CASE WHEN event_id % 2 = 0 THEN event_id END')} AS id FROM events""")
def _(spark, sf):
    rows = tb.table(spark, sf, "events")
    category = F.expr("CASE WHEN event_id % 2 = 0 THEN event_id END")
    return rows.select(
        "event_id", reco_id(F.lit("FORMATION"), F.col("user_id"), F.lit(None), category).alias("id")
    )


@query("recommendations_all", over("user_features series sla_features clusters", f"""
    SELECT *, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' + to_days(14) AS expires_at
    FROM ({_FORMATION} UNION ALL {_AUTOMATISATION} UNION ALL {_SURCHARGE} UNION ALL {_CAUSE})"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *dict.fromkeys((*USER_INPUT, *SLA_INPUT, "itilcategories_id")))
    out = recommend.recommendations(
        profiles=models.rule_profiles(features.user_features(rows)),
        concentration=features.incident_concentration(rows),
        forecasts=_last_days(spark, sf),
        team_sla=_team(spark, sf),
        clusters=tb.clusters(spark, sf),
        now=timestamp(NOW),
        rules=RULES,
    )
    return out.select(*_SHOWN, "created_at", "expires_at")
