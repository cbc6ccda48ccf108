"""Landing, name resolution, upserts and requester imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions.ids import content_fingerprint
from ticketlens.operators import requesters, resolve, rollups, shaping, upsert
from ticketlens.operators.filters import timestamp
from ticketlens.registry import query
from ticketlens.registry.expressions import _KEYS, _SHOWN, number, raw
from ticketlens.registry.sql import NOW, mean_days, over, share
from ticketlens.session import scratch_path
from ticketlens.sources import landing, testbed as tb
from ticketlens.sources.warehouse import Warehouse


# --- landing --------------------------------------------------------------------------------
@query("raw_ticket_remap", raw("""
    SELECT id, name, CAST(NULL AS VARCHAR) AS content, status, type, priority, itilcategories_id, date, date_mod,
        solvedate, closedate, time_to_resolve, _users_id_requester, _users_id_assign, entities_id,
        _groups_id_requester, urgency, CAST(NULL AS VARCHAR) AS impact FROM raw"""))
def _(spark, sf):
    # through landed JSON files, read back with the explicit all-text layout
    path = scratch_path(spark, "landing")
    tb.search_rows(spark, sf).write.json(path)
    return landing.remap_search_rows(landing.read_rows(spark, path, landing.TICKET_FIELDS))


@query("followup_normalize", """
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS items_id,
        CASE WHEN event_id % 3 = 1 THEN CAST(event_id + 7 AS VARCHAR)
            WHEN event_type IN ('click', 'view') THEN CAST(user_id AS VARCHAR)
            WHEN event_id % 3 = 0 THEN '0' END AS tickets_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'Ticket' WHEN event_type = 'error' THEN 'Problem' END AS itemtype,
        props AS content, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, CAST(user_id AS VARCHAR) AS users_id
    FROM events""")
def _(spark, sf):
    rows = tb.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("items_id"),
        F.expr("CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN CAST(event_id + 7 AS STRING) END").alias("tickets_id"),
        F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'Ticket' WHEN event_type = 'error' THEN 'Problem' END").alias("itemtype"),
        F.col("props").alias("content"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("user_id").alias("users_id"),
        F.col("value").alias("stray"),
    )
    return landing.normalize_followups(rows)


@query("scan_tickets", over("tickets", """
    SELECT id, name, content, status, type, priority, itilcategories_id, date, date_mod, solvedate, closedate,
        time_to_resolve, user_requester, user_assign, entities_id, groups_id_requester, urgency, impact, is_resolved,
        is_high_priority, round(resolution_days, 6) AS resolution_days, name_normalized FROM tickets"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, *tb.TICKET_COLUMNS)
    return rows.withColumn("resolution_days", F.round("resolution_days", 6))


_TIMES = ("date", "solvedate", "time_to_resolve")


@query("records_to_json", over("tickets", """
    SELECT '{"id":' || id || ',' || coalesce('"name":"' || name || '"', '"name":null') || ',' ||
        '"date":"' || strftime(date, '%Y-%m-%d %H:%M:%S') || '",' ||
        coalesce('"solvedate":"' || strftime(solvedate, '%Y-%m-%d %H:%M:%S') || '"', '"solvedate":null') || ',' ||
        coalesce('"time_to_resolve":"' || strftime(time_to_resolve, '%Y-%m-%d %H:%M:%S') || '"', '"time_to_resolve":null') || ',' ||
        '"is_resolved":' || is_resolved || '}' AS record FROM tickets"""))
def _(spark, sf):
    return shaping.to_records(tb.tickets(spark, sf, "name", *_TIMES, "is_resolved"))


@query("nested_to_json", over("clusters", """
    SELECT cluster_id, '["brand' || cluster_id || '"]' AS top_keywords,
        '{"label":"' || severity || '","n":' || ticket_count || '}' AS evidence FROM clusters"""))
def _(spark, sf):
    rows = tb.clusters(spark, sf).select(
        "cluster_id", "top_keywords",
        F.struct(F.col("severity").alias("label"), F.col("ticket_count").alias("n")).alias("evidence"),
    )
    return shaping.nested_to_json(rows, ["top_keywords", "evidence"])


@query("content_fingerprint")
def _(spark, sf):
    return content_fingerprint(tb.table(spark, sf, "lineitem"))


# --- name resolution ------------------------------------------------------------------------
def _spell(table: str, spellings: list[str]) -> str:
    parts = [f"SELECT id, {rank} AS rank, {s} AS shown FROM {table}" for rank, s in enumerate(spellings)]
    squeezed = "regexp_replace(trim(shown), '\\s+', ' ', 'g')"
    key = f"lower(regexp_replace({squeezed}, ' ?> ?', ' > ', 'g'))"
    return (
        f"SELECT key, id FROM (SELECT {key} AS key, id, row_number() OVER (PARTITION BY {key} ORDER BY rank, id) AS n "
        f"FROM ({' UNION ALL '.join(parts)}) WHERE lower({squeezed}) NOT IN ('', 'nan', 'none', '<na>')) WHERE n = 1"
    )


_TREE = ["completename", "name", "CASE WHEN contains(completename, '>') THEN string_split(completename, '>')[-1] END"]
_PERSON = [
    "coalesce(realname, '') || ' ' || coalesce(firstname, '')",
    "coalesce(firstname, '') || ' ' || coalesce(realname, '')",
    "name",
]
_MAPS = {
    "cat_keys": _spell("dim_categories", _TREE),
    "entity_keys": _spell("dim_entities", _TREE),
    "group_keys": _spell("dim_groups", _TREE),
    "user_keys": _spell("dim_users", _PERSON),
}
_MAP_OF = {
    "itilcategories_id": "cat_keys", "entities_id": "entity_keys", "groups_id_requester": "group_keys",
    "user_requester": "user_keys", "user_assign": "user_keys",
}


def _resolved_sql() -> str:
    cells, joins = ["CAST(s.id AS BIGINT) AS id"], []
    for i, (column, keys) in enumerate(_MAP_OF.items()):
        shown = f"s.{column}_display"
        squeezed = f"regexp_replace(trim({shown}), '\\s+', ' ', 'g')"
        key = f"lower(regexp_replace({squeezed}, ' ?> ?', ' > ', 'g'))"
        joins.append(f"LEFT JOIN {keys} k{i} ON k{i}.key = {key}")
        cells += [f"coalesce({number(shown)}, k{i}.id) AS {column}", f"{shown}"]
    return f"SELECT {', '.join(cells)} FROM shown s {' '.join(joins)}"


def _resolved(spark, sf):
    rows = shaping.conform(tb.raw_tickets(spark, sf, *_KEYS))
    keyed = shaping.coerce_foreign_keys(rows).withColumn("id", F.col("id").cast("bigint"))
    dims = {
        "dim_users": tb.users(spark, sf), "dim_entities": tb.entities(spark, sf),
        "dim_categories": tb.categories(spark, sf), "dim_groups": tb.groups(spark, sf),
    }
    out = resolve.resolve_display_names(keyed, dims)
    return out.select("id", *[c for k in resolve.TARGETS for c in (k, f"{k}_display")])


@query("resolve_display_names", raw(
    "SELECT id, " + ", ".join(_MAP_OF) + " FROM resolved", shown=_SHOWN, **_MAPS, resolved=_resolved_sql()))
def _(spark, sf):
    return _resolved(spark, sf).select("id", *resolve.TARGETS)


def _report_sql() -> str:
    parts = []
    for column in _MAP_OF:
        looked = f"{column}_display IS NOT NULL AND {number(f'{column}_display')} IS NULL"
        parts.append(f"""SELECT '{column}' AS fk_column, count(*) FILTER ({looked}) AS missing,
            count(*) FILTER ({looked} AND {column} IS NOT NULL) AS resolved,
            count(*) FILTER ({looked} AND {column} IS NULL) AS unmatched,
            coalesce(array_to_string(list_sort(list(DISTINCT {column}_display) FILTER ({looked} AND {column} IS NULL))[1:5], '|'), '') AS samples
            FROM resolved""")
    return " UNION ALL ".join(parts)


@query("fk_resolution_report", raw(
    f"SELECT * FROM ({_report_sql()})", shown=_SHOWN, **_MAPS, resolved=_resolved_sql()))
def _(spark, sf):
    report = resolve.fk_resolution_report(_resolved(spark, sf))
    return report.withColumn("samples", F.coalesce(F.array_join("samples", "|"), F.lit("")))


# --- upserts --------------------------------------------------------------------------------
@query("ensure_schema", """
    SELECT (SELECT count(*) FROM region) AS n_groups, CAST(12 AS INTEGER) AS created, CAST(0 AS INTEGER) AS created_again""")
def _(spark, sf):
    """Tables created on a fresh warehouse, then row counts after loading the groups."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    created = warehouse.ensure_schema()
    again = warehouse.ensure_schema()
    warehouse.upsert("dim_groups", tb.groups(spark, sf), timestamp(NOW))
    held = warehouse.read("dim_groups").agg(F.count(F.lit(1)).alias("n_groups"))
    return held.withColumns({"created": F.lit(len(created)), "created_again": F.lit(len(again))})


# Half of the tickets form the table, tickets from a later day on the batch; the batch lists
# every ticket twice (the higher urgency is the later one) and carries no impact column.
_BATCH_DAY = "1998-01-01"


@query("upsert_single_key", over("tickets", f"""
    SELECT coalesce(o.id, n.id) AS id,
        CASE WHEN n.id IS NOT NULL THEN n.status ELSE o.status END AS status,
        CASE WHEN n.id IS NOT NULL THEN n.urgency + 10 ELSE o.urgency END AS urgency,
        o.impact AS impact,
        CASE WHEN o.id IS NULL THEN TIMESTAMP '{NOW}' ELSE o.date END AS loaded_at
    FROM (SELECT * FROM tickets WHERE type = 1) o
    FULL JOIN (SELECT * FROM tickets WHERE date >= TIMESTAMP '{_BATCH_DAY}') n ON n.id = o.id"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "status", "urgency", "impact", "date", "type")
    current = rows.filter("type = 1").select(
        "id", "status", "urgency", "impact", F.col("date").alias("loaded_at")
    )
    late = rows.filter(F.col("date") >= timestamp(f"{_BATCH_DAY} 00:00:00")).select("id", "status", "urgency")
    batch = late.unionByName(late.withColumn("urgency", F.col("urgency") + 10))
    return upsert.merge_snapshot(
        current, batch, ["id"], order_by=["urgency"], stamp_on_insert=["loaded_at"], now=timestamp(NOW)
    )


@query("upsert_composite_key", over("tickets", f"""
    SELECT coalesce(o.c, n.c) AS category_id, CAST(coalesce(o.d, n.d) AS VARCHAR) AS forecast_date,
        CASE WHEN n.c IS NOT NULL THEN n.y ELSE o.y END AS predicted_count,
        CASE WHEN n.c IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2000-01-01' END AS computed_at
    FROM (SELECT itilcategories_id AS c, CAST(date AS DATE) AS d, CAST(count(*) AS DOUBLE) AS y FROM tickets
          WHERE itilcategories_id IS NOT NULL AND type = 1 GROUP BY 1, 2) o
    FULL JOIN (SELECT itilcategories_id AS c, CAST(date AS DATE) AS d, CAST(count(*) * 2 AS DOUBLE) AS y FROM tickets
          WHERE itilcategories_id IS NOT NULL AND type = 2 GROUP BY 1, 2) n ON n.c = o.c AND n.d = o.d"""))
def _(spark, sf):
    rows = tb.tickets(spark, sf, "itilcategories_id", "date", "type").filter("itilcategories_id IS NOT NULL")

    def counts(kind: int, factor: int):
        return (
            rows.filter(F.col("type") == kind)
            .groupBy(F.col("itilcategories_id").alias("category_id"), F.col("date").cast("date").alias("forecast_date"))
            .agg((F.count(F.lit(1)) * factor).cast("double").alias("predicted_count"))
        )

    current = counts(1, 1).withColumn("computed_at", timestamp("2000-01-01 00:00:00"))
    merged = upsert.merge_snapshot(
        current, counts(2, 2), ["category_id", "forecast_date"], stamp=["computed_at"], now=timestamp(NOW)
    )
    return merged.withColumn("forecast_date", F.col("forecast_date").cast("string"))


_KPI = f"""SELECT CAST(date AS DATE) AS date, count(*) AS total_tickets, round_even({share('is_resolved')} * 100, 8) AS resolved_pct,
    count(*) FILTER (is_high_priority) AS high_priority_count,
    round_even(coalesce({mean_days('is_resolved')}, 0), 8) AS avg_resolution_days FROM tickets"""


@query("upsert_daily_kpi", over("tickets", f"""
    SELECT CAST(date AS VARCHAR) AS date, total_tickets, resolved_pct, high_priority_count, avg_resolution_days
    FROM ({_KPI} GROUP BY 1)"""))
def _(spark, sf):
    """Days of incidents only are written first, then every day anew over the same table."""
    rows = tb.tickets(spark, sf, "date", "is_resolved", "is_high_priority", "resolution_days", "type")
    warehouse = Warehouse(spark, scratch_path(spark, "kpi"))
    for part in (rows.filter("type = 1"), rows):
        warehouse.upsert("fact_kpis_daily", rollups.daily_kpis(part, digits=8), timestamp(NOW))
    figures = ("total_tickets", "resolved_pct", "high_priority_count", "avg_resolution_days")
    return warehouse.read("fact_kpis_daily").select(F.col("date").cast("string").alias("date"), *figures)


@query("upsert_ack", over("recos", f"""
    SELECT coalesce(a.recommendation_id, n.id) AS recommendation_id, coalesce(a.user_id, 1) AS user_id,
        CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE a.acknowledged_at END AS acknowledged_at
    FROM acks a FULL JOIN (SELECT id FROM recos WHERE severity = 'CRITIQUE') n
        ON n.id = a.recommendation_id AND a.user_id = 1"""))
def _(spark, sf):
    again = tb.recommendations(spark, sf).filter("severity = 'CRITIQUE'").select(
        F.col("id").alias("recommendation_id"), F.lit(1).cast("bigint").alias("user_id")
    )
    return upsert.merge_snapshot(
        tb.acks(spark, sf), again, ["recommendation_id", "user_id"], stamp=["acknowledged_at"], now=timestamp(NOW)
    )


# --- requesters -----------------------------------------------------------------------------
_MISSING = """
    SELECT * FROM (SELECT o_orderkey AS id,
        NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND 1 + l_linenumber % 2 = 1) AS needs_group,
        NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R' AND 1 + l_linenumber % 3 = 1) AS needs_user
    FROM orders) WHERE needs_group OR needs_user"""
_MEMBERS = """
    SELECT c_custkey AS users_id, CAST(n_nationkey AS BIGINT) AS groups_id, n_name AS group_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 4 AND c_custkey <> 0"""


@query("missing_requester", f"SELECT * FROM ({_MISSING})")
def _(spark, sf):
    return requesters.missing_requester(tb.tickets(spark, sf), *tb.links(spark, sf))


@query("dept_members", _MEMBERS)
def _(spark, sf):
    return requesters.dept_members(*tb.departments(spark, sf))


_ASSIGNED = f"""
    WITH missing AS ({_MISSING}), members AS ({_MEMBERS}),
    numbered AS (SELECT *, row_number() OVER (ORDER BY users_id % 256, users_id, groups_id) - 1 AS pick FROM members)
    SELECT m.id AS tickets_id, CASE WHEN needs_group THEN groups_id END AS groups_id,
        CASE WHEN needs_group THEN group_name END AS group_name, CASE WHEN needs_user THEN users_id END AS users_id
    FROM missing m JOIN numbered n
        ON n.pick = ('0x' || substr(md5('42:' || m.id), 1, 15))::BIGINT % (SELECT count(*) FROM members)"""


@query("assign_requester", _ASSIGNED)
def _(spark, sf):
    missing = requesters.missing_requester(tb.tickets(spark, sf), *tb.links(spark, sf))
    return requesters.assign_requester(missing, requesters.dept_members(*tb.departments(spark, sf)))


@query("assignment_totals", f"""
    SELECT group_name, count(*) AS n_tickets FROM ({_ASSIGNED}) WHERE groups_id IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    missing = requesters.missing_requester(tb.tickets(spark, sf), *tb.links(spark, sf))
    assigned = requesters.assign_requester(missing, requesters.dept_members(*tb.departments(spark, sf)))
    return requesters.assignment_totals(assigned)
