"""Cleaning and labelling expressions over whole tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketlens.functions import cleaning, measures as m
from ticketlens.operators import features, shaping
from ticketlens.registry import query
from ticketlens.registry.sql import OPEN, SLA_MET, VIOLATED, flatten, over, share, user_name
from ticketlens.sources import landing, testbed as tb

# --- the landed rows of the test data, in SQL ------------------------------------------------
_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
_PADDED = "'Customer#' || lpad(user_requester::VARCHAR, 9, '0')"
RAW_SQL = f"""
    SELECT id::VARCHAR AS id, name, content, status::VARCHAR AS status, type::VARCHAR AS type,
        priority::VARCHAR AS priority,
        CASE id % 4 WHEN 0 THEN 'Catalog > Brand#' || itilcategories_id
            WHEN 1 THEN 'Brand#' || itilcategories_id
            WHEN 2 THEN '  catalog  >   BRAND#' || itilcategories_id || ' '
            ELSE itilcategories_id::VARCHAR END AS itilcategories_id,
        {_TIME.format(c='date')} AS date,
        CASE WHEN id % 31 = 0 THEN 'n/a' ELSE {_TIME.format(c='date_mod')} END AS date_mod,
        {_TIME.format(c='solvedate')} AS solvedate, {_TIME.format(c='closedate')} AS closedate,
        {_TIME.format(c='time_to_resolve')} AS time_to_resolve,
        CASE id % 4 WHEN 0 THEN '[{{"id": ' || user_requester || ', "name": "x"}}]'
            WHEN 1 THEN '["", {{"name": "' || {_PADDED} || '"}}]'
            WHEN 2 THEN {_PADDED} ELSE user_requester::VARCHAR END AS _users_id_requester,
        CASE WHEN id % 41 = 0 THEN 'Nobody ' || (id % 7)
            ELSE 'SUPPLIER#' || lpad((user_assign - 1000000)::VARCHAR, 9, '0') END AS _users_id_assign,
        CASE id % 4 WHEN 0 THEN '{{"completename": "x", "name": "NATION_' || entities_id || '"}}'
            WHEN 1 THEN 'nation_' || entities_id
            WHEN 2 THEN 'Anywhere > Nation ' || entities_id
            ELSE entities_id::VARCHAR END AS entities_id,
        CASE id % 3 WHEN 0 THEN '[[{{"id": ' || groups_id_requester || '}}]]'
            WHEN 1 THEN CASE WHEN groups_id_requester IS NULL THEN '[]' END
            ELSE groups_id_requester::VARCHAR END AS _groups_id_requester,
        urgency::VARCHAR AS urgency, impact::VARCHAR AS impact
    FROM tickets"""


def raw(select: str, **more: str) -> str:
    return over("tickets dims", select, raw=RAW_SQL, **more)


def number(cell: str) -> str:
    return f"CASE WHEN TRY_CAST({cell} AS DOUBLE) = floor(TRY_CAST({cell} AS DOUBLE)) THEN CAST(TRY_CAST({cell} AS DOUBLE) AS BIGINT) END"


@query("conform_schema", raw("""
    SELECT id, name, content, status, type, priority, itilcategories_id, date, date_mod, solvedate, closedate,
        time_to_resolve, _users_id_requester AS user_requester, _users_id_assign AS user_assign, entities_id,
        _groups_id_requester AS groups_id_requester, CAST(NULL AS VARCHAR) AS urgency, impact FROM raw"""))
def _(spark, sf):
    rows = tb.raw_tickets(spark, sf).drop("urgency").withColumn("stray", F.lit("x"))
    return shaping.conform(rows)


_CELLS = ("_users_id_requester", "_groups_id_requester", "entities_id")


@query("flatten_cell", raw(
    "SELECT id, " + ", ".join(f"{flatten(c)} AS {c.lstrip('_')}" for c in _CELLS) + " FROM raw"))
def _(spark, sf):
    rows = tb.raw_tickets(spark, sf, *_CELLS)
    return rows.select("id", *[cleaning.flatten_cell(F.col(c)).alias(c.lstrip("_")) for c in _CELLS])


_LAYOUTS = "[" + ", ".join(
    "'" + f.replace("yyyy", "%Y").replace("M", "%m").replace("d", "%d").replace("H", "%H")
    .replace("%H:mm:ss", "%H:%M:%S").replace("%H:mm", "%H:%M") + "'"
    for f in cleaning.DATE_FORMATS
) + "]"


def _lenient(c: str) -> str:
    return (
        f"coalesce(TRY_CAST({c} AS TIMESTAMP), "
        f"try_strptime(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), {_LAYOUTS}))"
    )


@query("parse_dates_lenient", raw(
    "SELECT id, " + ", ".join(f"{_lenient(c)} AS {c}" for c in shaping.DATES) + " FROM raw"))
def _(spark, sf):
    return shaping.parse_dates(tb.raw_tickets(spark, sf, *shaping.DATES))


_KEYS = {
    "itilcategories_id": "itilcategories_id", "entities_id": "entities_id",
    "_groups_id_requester": "groups_id_requester", "_users_id_requester": "user_requester",
    "_users_id_assign": "user_assign",
}
_SHOWN = "SELECT *, " + ", ".join(f"{flatten(r)} AS {c}_display" for r, c in _KEYS.items()) + " FROM raw"


@query("coerce_fk", raw(
    "SELECT id, " + ", ".join(f"{number(f'{c}_display')} AS {c}, {c}_display" for c in _KEYS.values())
    + " FROM shown", shown=_SHOWN))
def _(spark, sf):
    rows = shaping.conform(tb.raw_tickets(spark, sf, *_KEYS))
    keys = [c for k in shaping.FOREIGN_KEYS for c in (k, f"{k}_display")]
    return shaping.coerce_foreign_keys(rows).select("id", *keys)


@query("derive_flags", over("tickets", """
    SELECT id, coalesce(status IN (5, 6), false) AS is_resolved, coalesce(priority IN (5, 6), false) AS is_high_priority
    FROM tickets"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "status", "priority")
    return rows.select(
        "id", m.is_resolved(F.col("status")).alias("is_resolved"),
        m.is_high_priority(F.col("priority")).alias("is_high_priority"),
    )


@query("resolution_days", over("tickets", "SELECT id, round(resolution_days, 6) AS resolution_days FROM tickets"))
def _(spark, sf):
    days = m.days_between(F.col("date"), F.col("solvedate"))
    rows = tb.tickets(spark, sf, "date", "solvedate")
    return rows.select("id", F.round(days, 6).alias("resolution_days"))


@query("normalize_title", over("tickets", "SELECT id, name_normalized FROM tickets"))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "name")
    return rows.select("id", cleaning.normalize_title(F.col("name")).alias("name_normalized"))


_ENRICHED_TIMES = ", ".join(f"TRY_CAST({c} AS TIMESTAMP) AS {c}" for c in shaping.DATES)
_ENRICHED_KEYS = ", ".join(f"{number(f'{c}_display')} AS {c}, {c}_display" for c in _KEYS.values())
ENRICHED_SQL = f"""
    SELECT CAST(id AS BIGINT) AS id, name, content, CAST(status AS INTEGER) AS status,
        CAST(type AS INTEGER) AS type, CAST(priority AS INTEGER) AS priority,
        {_ENRICHED_TIMES}, {_ENRICHED_KEYS},
        CAST(urgency AS INTEGER) AS urgency, CAST(impact AS INTEGER) AS impact,
        CAST(status AS INTEGER) IN (5, 6) AS is_resolved, CAST(priority AS INTEGER) IN (5, 6) AS is_high_priority,
        round(date_diff('microsecond', TRY_CAST(date AS TIMESTAMP), TRY_CAST(solvedate AS TIMESTAMP)) / 86400000000.0::DOUBLE, 6) AS resolution_days,
        regexp_replace(lower(trim(coalesce(name, ''))), '^(\\s*(tr|re|fwd|fw)\\s*:\\s*)+', '') AS name_normalized
    FROM shown"""


@query("enrich_tickets", raw(f"SELECT * FROM ({ENRICHED_SQL})", shown=_SHOWN))
def _(spark, sf):
    rows = shaping.enrich(tb.raw_tickets(spark, sf))
    return rows.withColumn("resolution_days", F.round("resolution_days", 6))


# --- dimensions -----------------------------------------------------------------------------
_RAW_USERS = """
    SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS realname,
        CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS firstname,
        ['1', ' True', 'YES', 'off', '0', '', 'maybe', 'on ', 'NaN', 'f'][CAST(c_custkey % 10 AS INTEGER) + 1] AS is_active,
        CASE c_custkey % 3 WHEN 0 THEN '[{"id": ' || c_nationkey || '}]' WHEN 1 THEN c_nationkey::VARCHAR
            ELSE 'Root entity' END AS entities_id,
        '[' || c_nationkey || ', ' || (c_custkey % 7) || ']' AS groups_id
    FROM customer"""
_BOOL = """CASE WHEN lower(trim(is_active)) IN ('1', 'true', 't', 'yes', 'y', 'on') THEN true
    WHEN lower(trim(is_active)) IN ('0', 'false', 'f', 'no', 'n', 'off', '', 'none', 'nan') THEN false END"""


@query("raw_dim_slim", f"SELECT id, name, realname, firstname, is_active, entities_id, groups_id FROM ({_RAW_USERS})")
def _(spark, sf):
    return landing.slim(tb.raw_users(spark, sf), landing.DIMENSION_FIELDS["dim_users"])


@query("coerce_bool", f"SELECT id, {_BOOL} AS is_active FROM ({_RAW_USERS})")
def _(spark, sf):
    rows = tb.raw_users(spark, sf)
    return rows.select("id", cleaning.coerce_bool(F.col("is_active")).alias("is_active"))


@query("coerce_dim_types", f"""
    SELECT CAST(id AS BIGINT) AS id, {_BOOL} AS is_active, {number(flatten('entities_id'))} AS entities_id,
        name, realname, firstname, groups_id FROM ({_RAW_USERS})""")
def _(spark, sf):
    return shaping.type_dimension(tb.raw_users(spark, sf), "dim_users")


@query("normalize_display_name", raw("""
    SELECT id, CASE WHEN regexp_replace(trim(itilcategories_id), '\\s+', ' ', 'g') NOT IN ('', 'nan', 'none', '<na>')
        THEN lower(regexp_replace(regexp_replace(trim(itilcategories_id), '\\s+', ' ', 'g'), ' ?> ?', ' > ', 'g')) END AS shown
    FROM raw"""))
def _(spark, sf):
    rows = tb.raw_tickets(spark, sf, "itilcategories_id")
    return rows.select("id", cleaning.normalize_display_name(F.col("itilcategories_id")).alias("shown"))


@query("user_display_name", over("tickets dims", f"""
    SELECT f.fact_id, {user_name('f.fact_id')} AS name
    FROM (SELECT DISTINCT user_requester AS fact_id FROM tickets) f LEFT JOIN dim_users u ON u.id = f.fact_id"""))
def _(spark, sf):
    facts = tb.tickets(spark, sf, "user_requester").select(F.col("user_requester").alias("fact_id")).distinct()
    rows = facts.join(tb.users(spark, sf), F.col("fact_id") == F.col("id"), "left")
    return rows.select("fact_id", m.user_display_name(F.col("fact_id")).alias("name"))


@query("fallback_label", over("tickets dims", """
    SELECT t.id, coalesce(e.name, 'Site #' || t.entities_id::VARCHAR, 'Sans site') AS site,
        coalesce(c.name, 'Cat #' || t.itilcategories_id::VARCHAR, 'Sans catégorie') AS category
    FROM tickets t LEFT JOIN dim_entities e ON e.id = t.entities_id
    LEFT JOIN dim_categories c ON c.id = t.itilcategories_id"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "entities_id", "itilcategories_id")
    sites = tb.entities(spark, sf).select(F.col("id").alias("e"), F.col("name").alias("site_name"))
    cats = tb.categories(spark, sf).select(F.col("id").alias("c"), F.col("name").alias("cat_name"))
    rows = rows.join(sites, F.col("entities_id") == F.col("e"), "left").join(
        cats, F.col("itilcategories_id") == F.col("c"), "left"
    )
    return rows.select(
        "id",
        m.fallback_label(F.col("site_name"), F.col("entities_id"), "Site", "Sans site").alias("site"),
        m.fallback_label(F.col("cat_name"), F.col("itilcategories_id"), "Cat", "Sans catégorie").alias("category"),
    )


# --- bands ----------------------------------------------------------------------------------
_HIGH = share("is_high_priority")


@query("criticality_band", over("tickets", f"""
    SELECT user_requester, CASE WHEN {_HIGH} >= 0.5 THEN 'CRITIQUE' WHEN {_HIGH} >= 0.25 THEN 'ÉLEVÉ'
        WHEN {_HIGH} >= 0.1 THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS criticality FROM tickets GROUP BY 1"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "user_requester", "is_high_priority").groupBy("user_requester")
    high = m.share(F.col("is_high_priority"))
    return rows.agg(high.alias("h")).select(
        "user_requester", m.criticality_band(F.col("h")).alias("criticality")
    )


@query("severity_band", over("tickets", """
    SELECT user_assign, CASE WHEN count(*) >= 100 THEN 'CRITIQUE' WHEN count(*) >= 50 THEN 'ÉLEVÉ'
        WHEN count(*) >= 20 THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS severity FROM tickets GROUP BY 1"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "user_assign").groupBy("user_assign").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_assign", m.severity_band(F.col("n")).alias("severity"))


@query("sla_band", over("tickets", f"""
    SELECT user_requester, CASE WHEN p >= 90 THEN 'good' WHEN p >= 70 THEN 'warn' ELSE 'bad' END AS band,
        round(greatest(0, least(100, p)), 6) AS pct
    FROM (SELECT user_requester, {share(SLA_MET)} * 200 - 20 AS p FROM tickets GROUP BY 1)"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "user_requester", "solvedate", "time_to_resolve").groupBy("user_requester")
    # stretched beyond 0..100 so that the clamp matters
    p = m.share(m.sla_met(F.col("solvedate"), F.col("time_to_resolve"))) * 200.0 - 20.0
    return rows.agg(p.alias("p")).select(
        "user_requester", m.sla_band(F.col("p")).alias("band"),
        F.round(m.clamp_percent(F.col("p")), 6).alias("pct"),
    )


@query("months_active", over("tickets", """
    SELECT user_requester,
        round(coalesce(greatest(date_diff('microsecond', min(solvedate), max(solvedate)) / 86400000000.0::DOUBLE / 30, 1), 1), 6) AS months,
        round(coalesce(greatest(floor(date_diff('microsecond', min(solvedate), max(solvedate)) / 86400000000.0::DOUBLE) / 30, 1), 1), 6) AS months_whole_days
    FROM tickets GROUP BY 1"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "user_requester", "solvedate").groupBy("user_requester")
    first, last = F.min("solvedate"), F.max("solvedate")
    return rows.agg(
        F.round(m.months_active(first, last), 6).alias("months"),
        F.round(m.months_active(first, last, whole_days=True), 6).alias("months_whole_days"),
    )


@query("feature_matrix", over("user_features", "SELECT user_id, " + ", ".join(
    f"round({c}::DOUBLE, 6) AS {c}" for c in features.USER_FEATURES) + " FROM user_features"))
def _(spark, sf):
    rows = features.user_features(
        tb.tickets(spark, sf, "user_requester", "name_normalized", "status", "type", "priority",
                   "resolution_days", "date")
    )
    matrix = features.feature_matrix(rows, features.USER_FEATURES)
    cells = vector_to_array("features")
    return matrix.select(
        "user_id", *[F.round(cells[i], 6).alias(c) for i, c in enumerate(features.USER_FEATURES)]
    )


# --- predicates -----------------------------------------------------------------------------
@query("sla_met", over("tickets", f"SELECT id, {SLA_MET} AS sla_met FROM tickets"))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "solvedate", "time_to_resolve")
    return rows.select("id", m.sla_met(F.col("solvedate"), F.col("time_to_resolve")).alias("sla_met"))


@query("is_open", over("tickets", f"SELECT id, {OPEN} AS is_open FROM tickets"))
def _(spark, sf):
    return tb.tickets(spark, sf, "is_resolved").select("id", m.is_open(F.col("is_resolved")).alias("is_open"))


@query("sla_violated", over("tickets", f"SELECT id, {VIOLATED} AS violated FROM tickets"))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "solvedate", "closedate", "time_to_resolve")
    violated = m.sla_violated(F.col("solvedate"), F.col("closedate"), F.col("time_to_resolve"))
    return rows.select("id", violated.alias("violated"))
