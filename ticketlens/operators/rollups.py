"""Dashboard figures and roll-ups.

Every roll-up aggregates the fact on its key alone, cuts to the wanted rows, and only then
joins names and model results: one partial-aggregated shuffle of the fact, whatever its skew,
and joins against at most ``Filters.limit`` rows. ``digits`` is the display rounding of mean days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import measures as m
from ticketlens.operators.filters import Filters

_ALL = Filters()


def _count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _total() -> Column:
    return F.count(F.lit(1)).alias("total")


def _resolved() -> Column:
    return _count_if(F.col("is_resolved")).alias("resolved")


def _open() -> Column:
    return F.count_if(m.is_open(F.col("is_resolved"))).alias("open")


def _incidents() -> Column:
    return _count_if(F.col("type") == m.INCIDENT).alias("incidents")


def _requests() -> Column:
    return _count_if(F.col("type") == m.REQUEST).alias("requests")


def _high() -> Column:
    return _count_if(F.col("is_high_priority")).alias("high_priority")


def _sla_share() -> Column:
    return m.share(m.sla_met(F.col("solvedate"), F.col("time_to_resolve"))).alias("sla_share")


def _days() -> Column:
    return m.mean_days(F.col("resolution_days")).alias("avg_days")


def _biggest(df: DataFrame, key: str, n: int, by: str = "total") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc_nulls_last(key)).limit(n)


def _named(rows: DataFrame, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Attach dimension columns; a key without a dimension row keeps its figures."""
    side = dim.select(F.col("id").alias("_dim_id"), *columns)
    return rows.join(side, rows[key] == side["_dim_id"], "left")


_USER = ["name", "realname", "firstname"]


def _sla() -> Column:
    return m.percent(F.col("sla_share")).alias("sla_pct")


def _avg_days(digits: int) -> Column:
    return F.bround("avg_days", digits).alias("avg_resolution_days")


# --- overview -------------------------------------------------------------------------------
def overview_kpis(tickets: DataFrame, f: Filters = _ALL) -> DataFrame:
    """One row: total, resolved %, SLA %, number of sites other than the root."""
    one = f.apply(tickets).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.coalesce(m.share(F.col("is_resolved")), F.lit(0.0)).alias("resolved"),
        F.coalesce(_sla_share(), F.lit(0.0)).alias("sla"),
        F.count_distinct(F.nullif(F.col("entities_id"), F.lit(m.ROOT_ENTITY).cast("bigint"))).alias(
            "active_sites_count"
        ),
    )
    return one.select(
        "total_tickets",
        m.percent(F.col("resolved")).alias("resolved_pct"),
        m.percent(F.col("sla")).alias("sla_global_pct"),
        "active_sites_count",
    )


def repetitive_total(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.coalesce(F.sum("ticket_count"), F.lit(0)).alias("repetitive_count"))


def top_sites(tickets: DataFrame, entities: DataFrame, f: Filters = _ALL, n: int = 10) -> DataFrame:
    rows = f.apply(tickets).filter(m.not_root_entity(F.col("entities_id")))
    top = _biggest(rows.groupBy("entities_id").agg(_total()), "entities_id", n)
    shown = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Site #"), F.coalesce(F.col("entities_id").cast("string"), F.lit("None"))))
    return _named(top, entities, "entities_id", ["name"]).select(
        F.col("entities_id").alias("id"), shown.alias("name"), F.col("total").alias("count")
    )


def top_categories(
    tickets: DataFrame, categories: DataFrame, f: Filters = _ALL, n: int = 8
) -> DataFrame:
    key = "itilcategories_id"
    top = _biggest(f.apply(tickets).groupBy(key).agg(_total()), key, n)
    shown = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Cat #"), F.coalesce(F.col(key).cast("string"), F.lit("None"))))
    return _named(top, categories, key, ["name"]).select(
        F.col(key).alias("id"), shown.alias("name"), F.col("total").alias("count")
    )


def top_category(tickets: DataFrame, categories: DataFrame, f: Filters = _ALL) -> DataFrame:
    """Name of the biggest category."""
    return top_categories(tickets, categories, f, n=1).select(F.col("name").alias("top_category"))


def top_requesters(tickets: DataFrame, users: DataFrame, f: Filters = _ALL, n: int = 10) -> DataFrame:
    key = "user_requester"
    rows = f.apply(tickets).filter(F.col(key).isNotNull())
    top = _biggest(rows.groupBy(key).agg(_total()), key, n)
    return _named(top, users, key, _USER).select(
        F.col(key).alias("id"),
        m.user_display_name(F.col(key)).alias("name"),
        F.col("total").alias("count"),
    )


def sla_by_technician(
    tickets: DataFrame, users: DataFrame, f: Filters = _ALL, n: int = 15
) -> DataFrame:
    key = "user_assign"
    rows = f.apply(tickets).filter(F.col(key).isNotNull())
    top = _biggest(rows.groupBy(key).agg(_total(), _sla_share()), key, n)
    return _named(top, users, key, _USER).select(
        F.col(key).alias("technician_id"),
        m.user_display_name(F.col(key)).alias("name"),
        "total",
        _sla(),
    )


# --- tabs -----------------------------------------------------------------------------------
def requester_rollup(
    tickets: DataFrame,
    users: DataFrame,
    profiles: DataFrame,
    f: Filters = _ALL,
    repetitive: DataFrame | None = None,
) -> DataFrame:
    """Ranked requesters. ``repetitive`` (user_id, repetitive_count) is optional, else 0."""
    key = "user_requester"
    rows = f.apply(tickets).filter(F.col(key).isNotNull())
    figures = rows.groupBy(key).agg(
        _total(), _incidents(), _requests(), _open(), _high(),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    top = _biggest(figures, key, f.limit)
    # at most f.limit rows are left, so one task may number them
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), key)))
    side = profiles.select(F.col("user_id").alias("_p"), "profile")
    out = _named(top, users, key, _USER).join(side, F.col(key) == F.col("_p"), "left")
    if repetitive is None:
        count = F.lit(0).cast("bigint")
    else:
        seen = repetitive.select(F.col("user_id").alias("_r"), "repetitive_count")
        out = out.join(seen, F.col(key) == F.col("_r"), "left")
        count = F.coalesce(F.col("repetitive_count"), F.lit(0).cast("bigint"))
    months = m.months_active(F.col("first_date"), F.col("last_date"), whole_days=True)
    return out.select(
        "rank",
        F.col(key).alias("user_id"),
        m.user_display_name(F.col(key)).alias("name"),
        "total", "incidents", "requests", "open",
        count.alias("repetitive"),
        "high_priority",
        F.bround(F.col("total") / months, 2).alias("tickets_per_month"),
        "profile",
    )


def service_rollup(
    tickets: DataFrame, groups: DataFrame, f: Filters = _ALL, digits: int = 2
) -> DataFrame:
    key = "groups_id_requester"
    figures = f.apply(tickets).groupBy(key).agg(
        _total(), _high(), _open(), _incidents(), _requests(), _sla_share(), _days()
    )
    top = _biggest(figures, key, f.limit)
    return _named(top, groups, key, ["name", "completename"]).select(
        F.col(key).alias("service_id"),
        F.coalesce("completename", "name", F.lit("Sans service")).alias("service"),
        "total", "high_priority", "open",
        m.criticality_band(F.col("high_priority") / F.col("total")).alias("criticality"),
        "incidents", "requests", _sla(), _avg_days(digits),
    )


def site_rollup(
    tickets: DataFrame, entities: DataFrame, f: Filters = _ALL, digits: int = 2
) -> DataFrame:
    """Per site with its part of the filtered total; the root entity counts in neither."""
    key = "entities_id"
    rows = f.apply(tickets).filter(m.not_root_entity(F.col(key)))
    figures = rows.groupBy(key).agg(_total(), _resolved(), _open(), _sla_share(), _days())
    # a scalar subquery over two columns; a window would pull all sites into one task
    grand = rows.agg(F.count(F.lit(1))).scalar()
    top = _biggest(figures, key, f.limit).withColumn("total_tickets", grand)
    return _named(top, entities, key, ["name"]).select(
        F.col(key).alias("entity_id"),
        m.fallback_label(F.col("name"), F.col(key), "Site", "Sans site").alias("name"),
        "total", "resolved", "open",
        F.bround(100.0 * F.col("total") / F.col("total_tickets"), 1).alias("part_pct"),
        _sla(), _avg_days(digits), "total_tickets",
    )


def technician_rollup(
    tickets: DataFrame, users: DataFrame, risk: DataFrame, f: Filters = _ALL, digits: int = 2
) -> DataFrame:
    key = "user_assign"
    rows = f.apply(tickets).filter(F.col(key).isNotNull())
    top = _biggest(rows.groupBy(key).agg(_total(), _resolved(), _sla_share(), _days()), key, f.limit)
    side = risk.select(
        F.col("technician_id").alias("_t"), "risk_score", "next_48h_prediction",
        F.col("confidence").alias("risk_confidence"),
    )
    return (
        _named(top, users, key, _USER)
        .join(side, F.col(key) == F.col("_t"), "left")
        .select(
            F.col(key).alias("technician_id"),
            m.user_display_name(F.col(key)).alias("name"),
            "total", "resolved", (F.col("total") - F.col("resolved")).alias("open"),
            _sla(), _avg_days(digits), "risk_score", "next_48h_prediction", "risk_confidence",
        )
    )


def category_rollup(
    tickets: DataFrame, categories: DataFrame, f: Filters = _ALL, digits: int = 2
) -> DataFrame:
    key = "itilcategories_id"
    figures = f.apply(tickets).groupBy(key).agg(
        _total(), _resolved(), _days(), _incidents(), _requests(), _open(), _sla_share()
    )
    top = _biggest(figures, key, f.limit)
    return _named(top, categories, key, ["name"]).select(
        F.col(key).alias("category_id"),
        m.fallback_label(F.col("name"), F.col(key), "Cat", "Sans catégorie").alias("name"),
        "total", "resolved",
        F.bround(100.0 * F.col("resolved") / F.col("total"), 1).alias("resolution_rate"),
        _avg_days(digits), "incidents", "requests", "open", _sla(),
    )


def share_of_total(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Rows per ``key`` with their part of all rows."""
    counted = df.groupBy(key).agg(_total())
    grand = df.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("part_pct", F.bround(100.0 * F.col("total") / grand, digits))


# --- snapshot -------------------------------------------------------------------------------
def kpi_snapshot(tickets: DataFrame, digits: int = 2) -> DataFrame:
    """One row of figures over the whole frame; zeros when it is empty."""
    return tickets.agg(*_kpi_columns(digits))


def daily_kpis(tickets: DataFrame, digits: int = 2) -> DataFrame:
    """The same figures per creation day."""
    return (
        tickets.filter(F.col("date").isNotNull())
        .groupBy(F.col("date").cast("date").alias("day"))
        .agg(*_kpi_columns(digits))
        .withColumnRenamed("day", "date")
    )


def _kpi_columns(digits: int) -> list[Column]:
    zero = F.lit(0.0)
    days = m.mean_days(F.when(F.col("is_resolved"), F.col("resolution_days")))
    return [
        F.count(F.lit(1)).alias("total_tickets"),
        F.bround(F.coalesce(m.share(F.col("is_resolved")) * 100.0, zero), digits).alias("resolved_pct"),
        _count_if(F.col("is_high_priority")).alias("high_priority_count"),
        F.bround(F.coalesce(days, zero), digits).alias("avg_resolution_days"),
    ]


def freshness_count(tickets: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tickets modified within the last ``hours``."""
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    return tickets.filter(F.col("date_mod") >= since).agg(F.count(F.lit(1)).alias("recent"))


def global_sla_pct(tickets: DataFrame) -> DataFrame:
    """Part of finished tickets with a deadline that met it; 100 when there are none."""
    done = F.coalesce("solvedate", "closedate")
    met = F.when(done.isNotNull() & F.col("time_to_resolve").isNotNull(),
                 F.when(done <= F.col("time_to_resolve"), 1.0).otherwise(0.0))
    return tickets.agg(F.coalesce(F.avg(met) * 100.0, F.lit(100.0)).alias("sla_pct"))
