"""Dashboard figures, roll-ups, listings and joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ticketlens.functions import measures as m
from ticketlens.operators import features, filters, forecast, listings, models, ranking, rollups
from ticketlens.operators.filters import Filters, timestamp
from ticketlens.registry import query
from ticketlens.registry.sql import (
    EVENTS_NOW, NOW, OPEN, SEVERITY_KEY, SLA_MET, TODAY, mean_days, over, pct, share, user_name,
)
from ticketlens.sources import testbed as tb

WINDOW = Filters(start_date=dt.date(1996, 3, 1), end_date=dt.date(2000, 6, 30))
IN_WINDOW = "date >= TIMESTAMP '1996-03-01' AND date < TIMESTAMP '2000-07-01'"
DIGITS = 6  # enough to tell values apart; two digits of display are a last step
DAYS = f"round_even({mean_days()}, {DIGITS})"
NOT_ROOT = "(entities_id IS NULL OR entities_id <> 0)"
_FACT = ("date", "is_resolved", "solvedate", "time_to_resolve", "resolution_days")


def _long(sql: str) -> str:
    return f"CAST({sql} AS BIGINT)"


# --- overview -------------------------------------------------------------------------------
@query("overview_kpis", over("tickets", f"""
    SELECT count(*) AS total_tickets, {pct(share('is_resolved'))} AS resolved_pct,
        {pct(share(SLA_MET))} AS sla_global_pct,
        count(DISTINCT nullif(entities_id, 0)) AS active_sites_count
    FROM tickets WHERE {IN_WINDOW}"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "date", "is_resolved", "solvedate", "time_to_resolve", "entities_id")
    return rollups.overview_kpis(rows, WINDOW)


@query("repetitive_total", over("clusters", """
    SELECT CAST(coalesce(sum(ticket_count), 0) AS BIGINT) AS repetitive_count FROM clusters"""))
def _(spark, sf):
    return rollups.repetitive_total(tb.clusters(spark, sf))


@query("top_sites", over("tickets dims", f"""
    SELECT t.entities_id AS id, coalesce(e.name, 'Site #' || coalesce(t.entities_id::VARCHAR, 'None')) AS name,
        count(*) AS count
    FROM tickets t LEFT JOIN dim_entities e ON e.id = t.entities_id
    WHERE {IN_WINDOW} AND (t.entities_id IS NULL OR t.entities_id <> 0)
    GROUP BY t.entities_id, e.name ORDER BY count(*) DESC, t.entities_id NULLS LAST LIMIT 10"""))
def _(spark, sf):
    return rollups.top_sites(tb.tickets(spark, sf, "date", "entities_id"), tb.entities(spark, sf), WINDOW)


_TOP_CATEGORIES = over("tickets dims", f"""
    SELECT t.itilcategories_id AS id, coalesce(c.name, 'Cat #' || coalesce(t.itilcategories_id::VARCHAR, 'None')) AS name,
        count(*) AS count
    FROM tickets t LEFT JOIN dim_categories c ON c.id = t.itilcategories_id
    WHERE {IN_WINDOW} GROUP BY t.itilcategories_id, c.name
    ORDER BY count(*) DESC, t.itilcategories_id NULLS LAST LIMIT 8""")


@query("top_categories", _TOP_CATEGORIES)
def _(spark, sf):
    rows = tb.tickets(spark, sf, "date", "itilcategories_id")
    return rollups.top_categories(rows, tb.categories(spark, sf), WINDOW)


@query("top_category", f"SELECT name AS top_category FROM ({_TOP_CATEGORIES}) ORDER BY count DESC, id NULLS LAST LIMIT 1")
def _(spark, sf):
    rows = tb.tickets(spark, sf, "date", "itilcategories_id")
    return rollups.top_category(rows, tb.categories(spark, sf), WINDOW)


@query("top_requesters", over("tickets dims", f"""
    SELECT t.user_requester AS id, {user_name('t.user_requester')} AS name, count(*) AS count
    FROM tickets t LEFT JOIN dim_users u ON u.id = t.user_requester
    WHERE {IN_WINDOW} AND t.user_requester IS NOT NULL
    GROUP BY t.user_requester, u.realname, u.firstname, u.name
    ORDER BY count(*) DESC, t.user_requester LIMIT 10"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "date", "user_requester")
    return rollups.top_requesters(rows, tb.users(spark, sf), WINDOW)


@query("sla_by_technician", over("tickets dims", f"""
    SELECT t.user_assign AS technician_id, {user_name('t.user_assign')} AS name, count(*) AS total,
        {pct(share(SLA_MET))} AS sla_pct
    FROM tickets t LEFT JOIN dim_users u ON u.id = t.user_assign
    WHERE {IN_WINDOW} AND t.user_assign IS NOT NULL
    GROUP BY t.user_assign, u.realname, u.firstname, u.name
    ORDER BY count(*) DESC, t.user_assign LIMIT 15"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "date", "user_assign", "solvedate", "time_to_resolve")
    return rollups.sla_by_technician(rows, tb.users(spark, sf), WINDOW)


# --- tabs -----------------------------------------------------------------------------------
_FEATURE_COLUMNS = (
    "user_requester", "name_normalized", "status", "type", "priority", "resolution_days", "date",
)


@query("requester_rollup", over("tickets dims user_features", f"""
    SELECT CAST(row_number() OVER (ORDER BY total DESC, user_id) AS INTEGER) AS rank, * FROM (
        SELECT t.user_requester AS user_id, {user_name('t.user_requester')} AS name, count(*) AS total,
            count(*) FILTER (t.type = 1) AS incidents, count(*) FILTER (t.type = 2) AS requests,
            count(*) FILTER ({OPEN}) AS open, max(p.repetitive_count) AS repetitive,
            count(*) FILTER (is_high_priority) AS high_priority,
            round_even(count(*) / greatest(floor(date_diff('microsecond', min(t.date), max(t.date)) / 86400000000.0::DOUBLE)
                / 30.0::DOUBLE, 1.0::DOUBLE), 2) AS tickets_per_month,
            p.profile
        FROM tickets t LEFT JOIN dim_users u ON u.id = t.user_requester
        LEFT JOIN rule_profiles p ON p.user_id = t.user_requester
        WHERE {IN_WINDOW} AND t.user_requester IS NOT NULL
        GROUP BY t.user_requester, u.realname, u.firstname, u.name, p.profile
        ORDER BY total DESC, t.user_requester LIMIT 50)"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *_FEATURE_COLUMNS, "is_resolved", "is_high_priority")
    users = features.user_features(rows)
    return rollups.requester_rollup(
        rows, tb.users(spark, sf), models.rule_profiles(users), WINDOW, users
    )


SERVICE_SQL = over("tickets dims", f"""
    SELECT t.groups_id_requester AS service_id, coalesce(g.completename, g.name, 'Sans service') AS service,
        count(*) AS total, count(*) FILTER (is_high_priority) AS high_priority,
        count(*) FILTER ({OPEN}) AS open,
        CASE WHEN {share('is_high_priority')} >= 0.5 THEN 'CRITIQUE' WHEN {share('is_high_priority')} >= 0.25 THEN 'ÉLEVÉ'
            WHEN {share('is_high_priority')} >= 0.1 THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS criticality,
        count(*) FILTER (type = 1) AS incidents, count(*) FILTER (type = 2) AS requests,
        {pct(share(SLA_MET))} AS sla_pct, {DAYS} AS avg_resolution_days
    FROM tickets t LEFT JOIN dim_groups g ON g.id = t.groups_id_requester
    GROUP BY t.groups_id_requester, g.completename, g.name
    ORDER BY total DESC, t.groups_id_requester NULLS LAST LIMIT 50""")


@query("service_rollup", SERVICE_SQL)
def service_rollup(spark, sf):
    rows = tb.tickets(spark, sf, *_FACT, "groups_id_requester", "is_high_priority", "type")
    return rollups.service_rollup(rows, tb.groups(spark, sf), digits=DIGITS)


@query("site_rollup", over("tickets dims", f"""
    SELECT t.entities_id AS entity_id, coalesce(e.name, 'Site #' || t.entities_id::VARCHAR, 'Sans site') AS name,
        count(*) AS total, count(*) FILTER (is_resolved) AS resolved, count(*) FILTER ({OPEN}) AS open,
        round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tickets WHERE {IN_WINDOW} AND {NOT_ROOT}), 1) AS part_pct,
        {pct(share(SLA_MET))} AS sla_pct, {DAYS} AS avg_resolution_days,
        (SELECT count(*) FROM tickets WHERE {IN_WINDOW} AND {NOT_ROOT}) AS total_tickets
    FROM tickets t LEFT JOIN dim_entities e ON e.id = t.entities_id
    WHERE {IN_WINDOW} AND (t.entities_id IS NULL OR t.entities_id <> 0)
    GROUP BY t.entities_id, e.name ORDER BY total DESC, t.entities_id NULLS LAST LIMIT 50"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *_FACT, "entities_id")
    return rollups.site_rollup(rows, tb.entities(spark, sf), WINDOW, DIGITS)


@query("technician_rollup", over("tickets dims risk", f"""
    SELECT t.user_assign AS technician_id, {user_name('t.user_assign')} AS name, count(*) AS total,
        count(*) FILTER (is_resolved) AS resolved, count(*) - count(*) FILTER (is_resolved) AS open,
        {pct(share(SLA_MET))} AS sla_pct, {DAYS} AS avg_resolution_days,
        r.risk_score, r.next_48h_prediction, r.confidence AS risk_confidence
    FROM tickets t LEFT JOIN dim_users u ON u.id = t.user_assign
    LEFT JOIN risk r ON r.technician_id = t.user_assign
    WHERE {IN_WINDOW} AND t.user_assign IS NOT NULL
    GROUP BY t.user_assign, u.realname, u.firstname, u.name, r.risk_score, r.next_48h_prediction, r.confidence
    ORDER BY total DESC, t.user_assign LIMIT 50"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *_FACT, "user_assign")
    return rollups.technician_rollup(rows, tb.users(spark, sf), tb.risk(spark, sf), WINDOW, DIGITS)


@query("category_rollup", over("tickets dims", f"""
    SELECT t.itilcategories_id AS category_id,
        coalesce(c.name, 'Cat #' || t.itilcategories_id::VARCHAR, 'Sans catégorie') AS name,
        count(*) AS total, count(*) FILTER (is_resolved) AS resolved,
        round_even(100.0::DOUBLE * count(*) FILTER (is_resolved) / count(*), 1) AS resolution_rate,
        {DAYS} AS avg_resolution_days,
        count(*) FILTER (type = 1) AS incidents, count(*) FILTER (type = 2) AS requests,
        count(*) FILTER ({OPEN}) AS open, {pct(share(SLA_MET))} AS sla_pct
    FROM tickets t LEFT JOIN dim_categories c ON c.id = t.itilcategories_id
    WHERE {IN_WINDOW} AND entities_id = 3
    GROUP BY t.itilcategories_id, c.name ORDER BY total DESC, t.itilcategories_id NULLS LAST LIMIT 50"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *_FACT, "itilcategories_id", "entities_id", "type")
    f = Filters(WINDOW.start_date, WINDOW.end_date, entity_id=3)
    return rollups.category_rollup(rows, tb.categories(spark, sf), f, DIGITS)


@query("kpi_snapshot", over("tickets", f"""
    SELECT count(*) AS total_tickets, round_even({share('is_resolved')} * 100, {DIGITS}) AS resolved_pct,
        count(*) FILTER (is_high_priority) AS high_priority_count,
        round_even(coalesce({mean_days('is_resolved')}, 0), {DIGITS}) AS avg_resolution_days
    FROM tickets"""))
def _(spark, sf):
    return rollups.kpi_snapshot(
        tb.tickets(spark, sf, "is_resolved", "is_high_priority", "resolution_days"), DIGITS
    )


@query("global_sla_pct", over("tickets", """
    SELECT round(coalesce(avg(CASE WHEN coalesce(solvedate, closedate) <= time_to_resolve THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
        FILTER (coalesce(solvedate, closedate) IS NOT NULL AND time_to_resolve IS NOT NULL) * 100, 100), 6) AS sla_pct
    FROM tickets"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "solvedate", "closedate", "time_to_resolve")
    return rollups.global_sla_pct(rows).select(F.round("sla_pct", 6).alias("sla_pct"))


@query("freshness_count", over("tickets", f"""
    SELECT count(*) AS recent FROM tickets WHERE date_mod >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR"""))
def _(spark, sf):
    return rollups.freshness_count(tb.tickets(spark, sf, "date_mod"), timestamp(NOW))


# --- filters --------------------------------------------------------------------------------
@query("ticket_filters", over("tickets", f"""
    SELECT id, date FROM tickets WHERE {IN_WINDOW} AND entities_id = 7 AND itilcategories_id = 12"""))
def _(spark, sf):
    f = Filters(WINDOW.start_date, WINDOW.end_date, entity_id=7, category_id=12)
    rows = tb.tickets(spark, sf, "date", "entities_id", "itilcategories_id")
    return f.apply(rows).select("id", "date")


@query("exclude_root_entity", over("tickets", f"SELECT id, entities_id FROM tickets WHERE {NOT_ROOT}"))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "entities_id")
    return rows.filter(m.not_root_entity(F.col("entities_id")))


@query("not_expired", over("recos", f"""
    SELECT id FROM recos WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{EVENTS_NOW}'"""))
def _(spark, sf):
    rows = tb.recommendations(spark, sf)
    return rows.filter(m.not_expired(F.col("expires_at"), timestamp(EVENTS_NOW))).select("id")


@query("horizon_filter", over("forecasts", f"""
    SELECT category_id, CAST(forecast_date AS VARCHAR) AS forecast_date FROM forecasts
    WHERE forecast_date >= DATE '{TODAY}' AND forecast_date < DATE '{TODAY}' + 3"""))
def _(spark, sf):
    today = F.lit(TODAY).cast("date")
    rows = listings.horizon_filter(_forecasts(spark, sf), today)
    return rows.select("category_id", F.col("forecast_date").cast("string").alias("forecast_date"))


@query("table_search", over("", """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE contains(lower(c_custkey::VARCHAR), 'in') OR contains(lower(c_name), 'in') OR contains(lower(c_mktsegment), 'in')
    ORDER BY c_mktsegment DESC, c_custkey LIMIT 25 OFFSET 25"""))
def _(spark, sf):
    rows = tb.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return filters.table_search(
        rows, " IN ", sort_by="c_mktsegment", ascending=False, tie="c_custkey", page=2, page_size=25
    )


# --- joins ----------------------------------------------------------------------------------
@query("join_ticket_entity", over("tickets dims", """
    SELECT t.id, e.name, e.completename FROM tickets t LEFT JOIN dim_entities e ON e.id = t.entities_id"""))
def _(spark, sf):
    dim = tb.entities(spark, sf).select(F.col("id").alias("k"), "name", "completename")
    rows = tb.tickets(spark, sf, "entities_id").join(dim, F.col("entities_id") == F.col("k"), "left")
    return rows.select("id", "name", "completename")


@query("join_ticket_category", over("tickets dims", """
    SELECT t.id, c.name FROM tickets t LEFT JOIN dim_categories c ON c.id = t.itilcategories_id"""))
def _(spark, sf):
    dim = tb.categories(spark, sf).select(F.col("id").alias("k"), "name")
    rows = tb.tickets(spark, sf, "itilcategories_id")
    return rows.join(dim, F.col("itilcategories_id") == F.col("k"), "left").select("id", "name")


@query("join_ticket_group", over("tickets dims", """
    SELECT t.id, g.name FROM tickets t LEFT JOIN dim_groups g ON g.id = t.groups_id_requester"""))
def _(spark, sf):
    dim = tb.groups(spark, sf).select(F.col("id").alias("k"), "name")
    rows = tb.tickets(spark, sf, "groups_id_requester")
    return rows.join(dim, F.col("groups_id_requester") == F.col("k"), "left").select("id", "name")


@query("join_ticket_user", over("tickets dims", f"""
    SELECT t.id, {user_name('t.user_requester')} AS requester FROM tickets t
    LEFT JOIN dim_users u ON u.id = t.user_requester"""))
def _(spark, sf):
    dim = tb.users(spark, sf).withColumnRenamed("id", "k")
    rows = tb.tickets(spark, sf, "user_requester")
    return rows.join(dim, F.col("user_requester") == F.col("k"), "left").select(
        "id", m.user_display_name(F.col("user_requester")).alias("requester")
    )


@query("join_ticket_profile", over("user_features", """
    SELECT t.id, p.profile FROM tickets t LEFT JOIN rule_profiles p ON p.user_id = t.user_requester"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *_FEATURE_COLUMNS)
    side = models.rule_profiles(features.user_features(rows)).select("user_id", "profile")
    return rows.join(side, F.col("user_requester") == F.col("user_id"), "left").select("id", "profile")


@query("join_ticket_risk", over("risk", """
    SELECT t.id, r.risk_score FROM tickets t LEFT JOIN risk r ON r.technician_id = t.user_assign"""))
def _(spark, sf):
    side = tb.risk(spark, sf).select("technician_id", "risk_score")
    rows = tb.tickets(spark, sf, "user_assign")
    return rows.join(side, F.col("user_assign") == F.col("technician_id"), "left").select("id", "risk_score")


@query("join_reco_ack", over("recos", """
    SELECT r.id, (a.recommendation_id IS NOT NULL) AS acknowledged
    FROM recos r LEFT JOIN acks a ON a.recommendation_id = r.id AND a.user_id = 1"""))
def _(spark, sf):
    return listings.join_acks(tb.recommendations(spark, sf), tb.acks(spark, sf), 1).select(
        "id", "acknowledged"
    )


@query("reco_exists", over("recos", """
    SELECT a.id FROM (SELECT recommendation_id AS id FROM acks) a WHERE EXISTS (SELECT 1 FROM recos r WHERE r.id = a.id)"""))
def _(spark, sf):
    wanted = tb.acks(spark, sf).select(F.col("recommendation_id").alias("id"))
    return listings.reco_exists(tb.recommendations(spark, sf), wanted)


# --- ranking and charts ---------------------------------------------------------------------
@query("rank_rows", over("tickets", """
    SELECT user_requester, n, CAST(row_number() OVER (ORDER BY n DESC, user_requester) AS INTEGER) AS rank FROM (
        SELECT user_requester, count(*) AS n FROM tickets WHERE user_requester IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, user_requester LIMIT 20)"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "user_requester").filter("user_requester IS NOT NULL")
    counted = rows.groupBy("user_requester").agg(F.count(F.lit(1)).alias("n"))
    return ranking.rank_rows(counted, "n", "user_requester", 20)


@query("share_of_total", over("tickets", """
    SELECT itilcategories_id, count(*) AS total,
        round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tickets), 1) AS part_pct
    FROM tickets GROUP BY 1"""))
def _(spark, sf):
    return rollups.share_of_total(tb.tickets(spark, sf, "itilcategories_id"), "itilcategories_id")


_BY_TECH = """SELECT user_assign AS technician, count(*) AS total, count(*) FILTER (type = 1) AS incidents,
    count(*) FILTER (type = 2) AS requests FROM tickets WHERE user_assign IS NOT NULL GROUP BY 1
    ORDER BY total DESC, technician LIMIT 15"""


def _by_tech(spark, sf):
    rows = tb.tickets(spark, sf, "user_assign", "type").filter("user_assign IS NOT NULL")
    return rows.groupBy(F.col("user_assign").alias("technician")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") == 1).alias("incidents"),
        F.count_if(F.col("type") == 2).alias("requests"),
    )


@query("top_series", over("tickets", f"""
    SELECT technician::VARCHAR AS label, 'total' AS series, total::DOUBLE AS value FROM ({_BY_TECH})"""))
def _(spark, sf):
    return ranking.top_series(_by_tech(spark, sf), "technician", ["total"], "total", "technician")


@query("stacked_series", over("tickets", f"""
    SELECT technician::VARCHAR AS label, 'incidents' AS series, incidents::DOUBLE AS value FROM ({_BY_TECH})
    UNION ALL SELECT technician::VARCHAR, 'requests', requests::DOUBLE FROM ({_BY_TECH})"""))
def _(spark, sf):
    parts = ["incidents", "requests"]
    return ranking.top_series(_by_tech(spark, sf), "technician", parts, "total", "technician")


# --- listings -------------------------------------------------------------------------------
@query("severity_order", over("recos", f"SELECT id, severity, {SEVERITY_KEY} AS severity_rank FROM recos"))
def _(spark, sf):
    rows = tb.recommendations(spark, sf)
    return rows.select("id", "severity", m.severity_order(F.col("severity")).alias("severity_rank"))


@query("cluster_listing", over("clusters", f"""
    SELECT cluster_id, algorithm, severity, ticket_count, first_seen, last_seen FROM clusters
    ORDER BY {SEVERITY_KEY}, ticket_count DESC, cluster_id, algorithm LIMIT 12"""))
def _(spark, sf):
    return listings.cluster_listing(tb.clusters(spark, sf), 12).select(
        "cluster_id", "algorithm", "severity", "ticket_count", "first_seen", "last_seen"
    )


@query("sla_risk_listing", over("risk dims", f"""
    SELECT r.technician_id, {user_name('r.technician_id')} AS name, r.risk_score, r.next_48h_prediction, r.confidence
    FROM risk r LEFT JOIN dim_users u ON u.id = r.technician_id
    ORDER BY r.risk_score DESC NULLS LAST, r.technician_id LIMIT 50"""))
def _(spark, sf):
    return listings.sla_risk_listing(tb.risk(spark, sf), tb.users(spark, sf))


def _forecasts(spark, sf):
    rows = tb.tickets(spark, sf, "date", "itilcategories_id")
    return forecast.forecast_average(features.daily_category_counts(rows))


@query("forecast_listing", over("forecasts dims", f"""
    SELECT f.category_id, c.name AS category_name, CAST(f.forecast_date AS VARCHAR) AS forecast_date,
        f.predicted_count, f.lower_bound, f.upper_bound, f.confidence
    FROM forecasts f LEFT JOIN dim_categories c ON c.id = f.category_id
    WHERE f.forecast_date >= DATE '{TODAY}' AND f.forecast_date < DATE '{TODAY}' + 3"""))
def _(spark, sf):
    today = F.lit(TODAY).cast("date")
    rows = listings.forecast_listing(_forecasts(spark, sf), tb.categories(spark, sf), today)
    return rows.withColumn("forecast_date", F.col("forecast_date").cast("string"))


@query("top_alerts", over("recos", f"""
    SELECT id AS recommendation_id, severity, type, title, description, created_at FROM recos
    WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{EVENTS_NOW}'
    ORDER BY {SEVERITY_KEY}, created_at DESC, id LIMIT 4"""))
def _(spark, sf):
    return listings.top_alerts(tb.recommendations(spark, sf), timestamp(EVENTS_NOW))


@query("reco_listing", over("recos", f"""
    SELECT r.*, (a.recommendation_id IS NOT NULL) AS acknowledged
    FROM recos r LEFT JOIN acks a ON a.recommendation_id = r.id AND a.user_id = 1
    WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{EVENTS_NOW}') AND type = 'FORMATION' AND severity = 'FAIBLE'
    ORDER BY {SEVERITY_KEY}, created_at DESC, id LIMIT 50"""))
def _(spark, sf):
    return listings.reco_listing(
        tb.recommendations(spark, sf), tb.acks(spark, sf), 1, timestamp(EVENTS_NOW),
        reco_type="FORMATION", severity="FAIBLE",
    )


@query("alert_high_water", over("recos", "SELECT max(created_at) AS high_water FROM recos"))
def _(spark, sf):
    return listings.high_water(tb.recommendations(spark, sf), timestamp(EVENTS_NOW))
