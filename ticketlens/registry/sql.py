"""SQL text shared by the oracles: the ticket model over the given tables."""

from __future__ import annotations

NOW = "2001-08-01 00:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"
TODAY = "2001-07-30"

_TICKETS = """
lines_of AS (
    SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey
),
base AS (
    SELECT o_orderkey AS id,
        CASE o_orderkey % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'FW: Re: ' ELSE '' END || p_type AS name,
        CAST(NULL AS VARCHAR) AS content,
        CAST(CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'P' THEN 5 ELSE
            CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 5 END END AS INTEGER) AS status,
        CAST(1 + o_orderkey % 2 AS INTEGER) AS type,
        CAST(CASE o_orderpriority
            WHEN '1-URGENT' THEN CASE WHEN o_orderkey % 4 = 0 THEN 6 ELSE 4 END
            WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE 4 END
            WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END AS INTEGER) AS priority,
        CASE WHEN p_brand IS NOT NULL AND o_orderkey % 211 = 0 THEN 900
            ELSE CAST(replace(p_brand, 'Brand#', '') AS BIGINT) END AS itilcategories_id,
        o_orderdate AS date,
        CASE WHEN o_orderkey % 50 = 0 THEN NULL
            WHEN o_orderkey % 97 = 0 THEN o_custkey + 5000000 ELSE o_custkey END AS user_requester,
        sk + 1000000 AS user_assign,
        CASE WHEN o_orderkey % 75 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS entities_id,
        CASE WHEN o_orderkey % 60 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS groups_id_requester
    FROM orders
    LEFT JOIN lines_of ON l_orderkey = o_orderkey
    LEFT JOIN part ON p_partkey = pk
    LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN nation ON n_nationkey = c_nationkey
),
solved AS (
    SELECT *, priority AS urgency, CAST(greatest(1, priority - 1) AS INTEGER) AS impact,
        CASE WHEN status IN (5, 6) THEN date + to_hours(CAST((id * 37) % 100 AS INTEGER)) END AS solvedate
    FROM base
),
closed AS (
    SELECT *, CASE WHEN status = 6 THEN solvedate + to_hours(CAST(id % 48 AS INTEGER)) END AS closedate
    FROM solved
),
tickets AS (
    SELECT *, coalesce(closedate, solvedate, date) AS date_mod,
        CASE WHEN id % 7 <> 0 THEN date + to_hours(
            CASE priority WHEN 6 THEN 4 WHEN 5 THEN 8 WHEN 4 THEN 24 WHEN 3 THEN 48 ELSE 72 END) END
            AS time_to_resolve,
        status IN (5, 6) AS is_resolved,
        priority IN (5, 6) AS is_high_priority,
        date_diff('microsecond', date, solvedate) / 86400000000.0::DOUBLE AS resolution_days,
        regexp_replace(lower(trim(coalesce(name, ''))), '^(\\s*(tr|re|fwd|fw)\\s*:\\s*)+', '') AS name_normalized
    FROM closed
)"""

_DIMS = """
dim_users AS (
    SELECT c_custkey AS id, c_name AS name,
        CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS realname,
        CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS firstname
    FROM customer
    UNION ALL
    SELECT s_suppkey + 1000000, s_name, NULL, NULL FROM supplier
),
dim_entities AS (
    SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
        r_name || ' > ' || n_name AS completename
    FROM nation JOIN region ON n_regionkey = r_regionkey
),
dim_categories AS (
    SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS id, p_brand AS name,
        'Catalog > ' || p_brand AS completename
    FROM part
),
dim_groups AS (
    SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, r_name AS completename FROM region
)"""

SLA_MET = "(solvedate IS NOT NULL AND (time_to_resolve IS NULL OR solvedate <= time_to_resolve))"
OPEN = "(is_resolved IS NOT TRUE)"
VIOLATED = """coalesce(CASE WHEN coalesce(solvedate, closedate) IS NOT NULL
    THEN coalesce(solvedate, closedate) > time_to_resolve
    ELSE time_to_resolve IS NOT NULL END, false)"""



def mean_days(condition: str = "true") -> str:
    """Mean resolution days over exact sums of microseconds."""
    micros = "CAST(round(resolution_days * 86400000000.0::DOUBLE) AS HUGEINT)"
    return (
        f"((sum({micros}) FILTER ({condition}))::DOUBLE / (count(resolution_days) FILTER ({condition}))"
        " / 86400000000.0::DOUBLE)"
    )


_RECOS = """
recos AS (
    SELECT 'r' || event_id AS id,
        CASE event_type WHEN 'click' THEN 'FORMATION' WHEN 'error' THEN 'SURCHARGE'
            WHEN 'purchase' THEN 'CAUSE_RACINE' ELSE 'AUTOMATISATION' END AS type,
        user_id AS target_user_id,
        CASE event_type WHEN 'error' THEN 'CRITIQUE' WHEN 'purchase' THEN 'ÉLEVÉ'
            WHEN 'signup' THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS severity,
        'Event ' || event_id AS title, event_type AS description, props AS evidence,
        ts AS created_at,
        CASE WHEN event_id % 5 <> 0 THEN ts + to_days(14) END AS expires_at
    FROM events
),
acks AS (
    SELECT 'r' || (event_id + 1) AS recommendation_id, user_id % 3 AS user_id, ts AS acknowledged_at
    FROM events WHERE event_type IN ('click', 'view')
)"""

_CLUSTERS = """
clusters AS (
    SELECT itilcategories_id AS cluster_id,
        CASE WHEN itilcategories_id % 2 = 1 THEN 'dbscan' ELSE 'kmeans' END AS algorithm,
        count(*) AS ticket_count,
        CASE WHEN count(*) >= 100 THEN 'CRITIQUE' WHEN count(*) >= 50 THEN 'ÉLEVÉ'
            WHEN count(*) >= 20 THEN 'MODÉRÉ' ELSE 'FAIBLE' END AS severity,
        min(date) AS first_seen, max(date) AS last_seen
    FROM tickets WHERE itilcategories_id IS NOT NULL GROUP BY 1, 2
)"""

_RISK = """
risk AS (
    SELECT user_assign AS technician_id,
        CASE WHEN user_assign % 9 = 0 THEN NULL
            ELSE round_even(avg(CASE WHEN is_high_priority THEN 1.0 ELSE 0.0 END), 4) END AS risk_score,
        CAST(count(*) % 2 AS INTEGER) AS next_48h_prediction, 'high' AS confidence
    FROM tickets WHERE user_assign IS NOT NULL GROUP BY 1
)"""

_USER_FEATURES = f"""
by_title AS (
    SELECT user_requester AS user_id, name_normalized, count(*) AS n
    FROM tickets WHERE user_requester IS NOT NULL GROUP BY 1, 2
),
repeated AS (
    SELECT user_id, sum(CASE WHEN name_normalized <> '' AND n >= 3 THEN n ELSE 0 END)::BIGINT AS repetitive_count
    FROM by_title GROUP BY 1
),
user_features AS (
    SELECT user_requester AS user_id, count(*) AS total_tickets,
        count(*) FILTER (type = 1) AS incidents_count, count(*) FILTER (type = 2) AS requests_count,
        count(*) FILTER (status IN (5, 6)) AS resolved_count,
        count(*) FILTER (status NOT IN (5, 6)) AS open_count,
        count(*) FILTER (priority IN (5, 6)) AS high_priority_count,
        max(repetitive_count) AS repetitive_count,
        coalesce({mean_days('status IN (5, 6)')}, 0) AS avg_resolution_days,
        round_even(count(*) / coalesce(greatest(
            date_diff('microsecond', min(date), max(date)) / 86400000000.0::DOUBLE / 30.0::DOUBLE, 1.0::DOUBLE),
            1.0::DOUBLE), 3) AS tickets_per_month
    FROM tickets JOIN repeated ON user_id = user_requester GROUP BY 1
),
rule_profiles AS (
    SELECT *, CASE
        WHEN high_priority_count / total_tickets >= 0.30::DOUBLE
            OR (high_priority_count >= 3 AND avg_resolution_days >= 5) THEN 'critique'
        WHEN tickets_per_month >= 4 OR repetitive_count >= 5 OR total_tickets >= 20 THEN 'dependant'
        WHEN total_tickets <= 5 AND resolved_count / total_tickets >= 0.8::DOUBLE
            AND high_priority_count = 0 THEN 'autonome'
        ELSE 'standard' END AS profile
    FROM user_features
)"""

_SLA_FEATURES = f"""
sla_features AS (
    SELECT user_assign AS technician_id,
        count(*) FILTER (status NOT IN (5, 6)) AS current_open_tickets,
        count(*) FILTER (date >= TIMESTAMP '{NOW}' - to_days(7)) AS tickets_last_7_days,
        coalesce({mean_days(f"status IN (5, 6) AND date >= TIMESTAMP '{NOW}' - to_days(30)")}, 0)
            AS avg_resolution_days_last_30_days,
        round_even(avg(CASE WHEN priority IN (5, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS high_priority_ratio,
        round_even(coalesce(avg(CASE WHEN {VIOLATED} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)
            FILTER (status IN (5, 6)) * 100, 100), 2) AS historical_sla_pct,
        CAST(max(CASE WHEN {VIOLATED} THEN 1 ELSE 0 END) AS INTEGER) AS sla_violation
    FROM tickets WHERE user_assign IS NOT NULL GROUP BY 1
)"""

_SERIES = """
daily AS (
    SELECT itilcategories_id AS category_id, CAST(date AS DATE) AS ds, count(*) AS y
    FROM tickets WHERE itilcategories_id IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2
),
leading_categories AS (
    SELECT category_id, min(ds) AS first, max(ds) AS last FROM daily
    GROUP BY 1 ORDER BY sum(y) DESC, category_id LIMIT 10
),
series AS (
    SELECT c.category_id, c.ds, coalesce(d.y, 0) AS y
    FROM (SELECT category_id, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
          FROM leading_categories) c
    LEFT JOIN daily d ON d.category_id = c.category_id AND d.ds = c.ds
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY ds DESC) AS back,
        count(*) OVER (PARTITION BY category_id) AS size
    FROM series
)"""

_AVERAGE = """
recent_points AS (
    SELECT category_id, avg(y) AS mean, stddev_pop(y) AS std, max(ds) AS last_ds
    FROM numbered WHERE back <= 14 GROUP BY 1
),
forecasts AS (
    SELECT category_id, CAST(last_ds + step AS DATE) AS forecast_date,
        round_even(mean, 2) AS predicted_count,
        round_even(greatest(mean - 1.96::DOUBLE * std, 0), 2) AS lower_bound,
        round_even(mean + 1.96::DOUBLE * std, 2) AS upper_bound, 'low' AS confidence
    FROM recent_points, (SELECT unnest([1, 2, 3]) AS step)
)"""

_PARTS = {
    "tickets": (_TICKETS, ()),
    "dims": (_DIMS, ()),
    "recos": (_RECOS, ()),
    "clusters": (_CLUSTERS, ("tickets",)),
    "risk": (_RISK, ("tickets",)),
    "user_features": (_USER_FEATURES, ("tickets",)),
    "sla_features": (_SLA_FEATURES, ("tickets",)),
    "series": (_SERIES, ("tickets",)),
    "forecasts": (_AVERAGE, ("series",)),
}


def over(parts: str, select: str, **ctes: str) -> str:
    """``select`` behind the CTEs named in ``parts`` (and what they need), then ``ctes``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for below in _PARTS[name][1]:
            need(below)
        if name not in ordered:
            ordered.append(name)

    for name in parts.split():
        need(name)
    texts = [_PARTS[name][0].strip() for name in ordered]
    texts += [f"{name} AS ({body})" for name, body in ctes.items()]
    return f"WITH {','.join(texts)} {select}" if texts else select


def user_name(fact_id: str) -> str:
    return (
        "coalesce(nullif(trim(coalesce(u.realname, '') || ' ' || coalesce(u.firstname, '')), ''), "
        f"u.name, 'user #' || {fact_id}::VARCHAR, 'Inconnu')"
    )


def pct(expr: str, digits: int = 1) -> str:
    return f"round_even({expr} * 100, {digits})"


def share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


SEVERITY_KEY = "CASE severity WHEN 'CRITIQUE' THEN 0 WHEN 'ÉLEVÉ' THEN 1 WHEN 'MODÉRÉ' THEN 2 ELSE 3 END"


def flatten(cell: str) -> str:
    """First meaningful scalar of a landed cell (lists up to two deep)."""

    def of_object(e: str) -> str:
        return (
            f"coalesce(nullif({e} ->> '$.id', ''), nullif({e} ->> '$.name', ''), "
            f"nullif({e} ->> '$.completename', ''))"
        )

    def flat(e: str, depth: int) -> str:
        inner = f"x{depth}"
        arrays = ""
        if depth:
            arrays = (
                f" WHEN 'ARRAY' THEN list_filter(list_transform(CAST({e} AS JSON[]), "
                f"lambda {inner}: {flat(inner, depth - 1)}), lambda f{depth}: f{depth} IS NOT NULL AND f{depth} <> '')[1]"
            )
        return f"CASE json_type({e}) WHEN 'OBJECT' THEN {of_object(e)}{arrays} ELSE {e} ->> '$' END"

    valid = f"regexp_matches({cell}, '^\\s*[\\[{{]') AND json_valid({cell})"
    return f"CASE WHEN {valid} THEN {flat(f'CAST({cell} AS JSON)', 2)} ELSE {cell} END"
