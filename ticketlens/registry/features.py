"""Features, series, forecasts, profiles, risk and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.operators import features, forecast, metrics, models, rollups
from ticketlens.operators.filters import timestamp
from ticketlens.registry import query
from ticketlens.registry.sql import NOW, over
from ticketlens.session import cut_lineage
from ticketlens.sources import testbed as tb

USER_INPUT = (
    "user_requester", "name_normalized", "status", "type", "priority", "resolution_days", "date",
)
SLA_INPUT = (
    "user_assign", "status", "priority", "date", "solvedate", "closedate", "time_to_resolve",
    "resolution_days",
)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def user_features(spark, sf):
    return features.user_features(tb.tickets(spark, sf, *USER_INPUT))


def sla_features(spark, sf):
    return features.sla_features(tb.tickets(spark, sf, *SLA_INPUT), timestamp(NOW))


def series(spark, sf):
    return features.daily_category_counts(tb.tickets(spark, sf, "date", "itilcategories_id"))


_USER_COLUMNS = """user_id, total_tickets, incidents_count, requests_count, resolved_count, open_count,
    high_priority_count, repetitive_count, round(avg_resolution_days, 6) AS avg_resolution_days, tickets_per_month"""


@query("user_features", over("user_features", f"SELECT {_USER_COLUMNS} FROM user_features"))
def _(spark, sf):
    return rounded(user_features(spark, sf), "avg_resolution_days")


@query("repetitive_titles", over("tickets", """
    SELECT user_id, CAST(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS BIGINT) AS repetitive_count FROM (
        SELECT user_requester AS user_id, name_normalized, count(*) AS n FROM tickets
        WHERE user_requester IS NOT NULL AND name_normalized <> '' GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    return features.repetitive_titles(tb.tickets(spark, sf, "user_requester", "name_normalized"))


@query("sla_features", over("sla_features", """
    SELECT technician_id, current_open_tickets, tickets_last_7_days,
        round(avg_resolution_days_last_30_days, 6) AS avg_resolution_days_last_30_days,
        high_priority_ratio, historical_sla_pct, sla_violation FROM sla_features"""))
def _(spark, sf):
    return rounded(sla_features(spark, sf), "avg_resolution_days_last_30_days")


@query("top_n_categories", over("tickets", """
    SELECT itilcategories_id AS category_id, count(*) AS n FROM tickets WHERE itilcategories_id IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, category_id LIMIT 10"""))
def _(spark, sf):
    return features.top_n_categories(tb.tickets(spark, sf, "itilcategories_id"))


@query("daily_category_counts", over("series", "SELECT category_id, CAST(ds AS VARCHAR) AS ds, y FROM series"))
def _(spark, sf):
    return series(spark, sf).withColumn("ds", F.col("ds").cast("string"))


CONCENTRATION_SQL = """
    SELECT user_id, sum(n) FILTER (pos <= 2) / sum(n) * 100 AS pct,
        list(cat ORDER BY pos) FILTER (pos <= 2) AS categories
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cat) AS pos FROM (
        SELECT user_requester AS user_id, itilcategories_id AS cat, count(*) AS n FROM tickets
        WHERE user_requester IS NOT NULL AND type = 1 AND itilcategories_id IS NOT NULL GROUP BY 1, 2))
    GROUP BY 1"""


@query("incident_concentration", over("tickets", f"""
    SELECT user_id, round(pct, 6) AS pct, array_to_string(categories, ',') AS categories
    FROM ({CONCENTRATION_SQL})"""))
def _(spark, sf):
    rows = features.incident_concentration(tb.tickets(spark, sf, "user_requester", "type", "itilcategories_id"))
    joined = F.array_join(F.col("categories").cast("array<string>"), ",")
    return rounded(rows, "pct").withColumn("categories", joined)


@query("team_sla", over("sla_features", "SELECT round(avg(historical_sla_pct), 6) AS team_sla_pct FROM sla_features"))
def _(spark, sf):
    fallback = rollups.global_sla_pct(tb.tickets(spark, sf, "solvedate", "closedate", "time_to_resolve"))
    return rounded(features.team_sla(sla_features(spark, sf), fallback), "team_sla_pct")


@query("forecast_peak_mean", over("forecasts", """
    SELECT category_id, max(predicted_count) AS peak, round(avg(predicted_count), 6) AS mean FROM forecasts GROUP BY 1"""))
def _(spark, sf):
    return rounded(forecast.peak_and_mean(forecast.forecast_average(series(spark, sf))), "mean")


# --- series ---------------------------------------------------------------------------------
@query("trailing_stats", over("series", """
    SELECT category_id, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, CAST(max(ds) AS VARCHAR) AS last_ds
    FROM numbered WHERE back <= 14 GROUP BY 1"""))
def _(spark, sf):
    rows = rounded(forecast.trailing_stats(series(spark, sf)), "mean", "std")
    return rows.withColumn("last_ds", F.col("last_ds").cast("string"))


@query("series_holdout_split", over("series", """
    SELECT category_id, CAST(ds AS VARCHAR) AS ds, y, CASE WHEN back <= 3 THEN 'test' ELSE 'train' END AS part FROM numbered"""))
def _(spark, sf):
    return forecast.holdout_split(series(spark, sf)).withColumn("ds", F.col("ds").cast("string"))


@query("volume_forecast_avg", over("forecasts", """
    SELECT category_id, CAST(forecast_date AS VARCHAR) AS forecast_date, predicted_count, lower_bound, upper_bound, confidence
    FROM forecasts"""))
def _(spark, sf):
    rows = forecast.forecast_average(series(spark, sf))
    return rows.withColumn("forecast_date", F.col("forecast_date").cast("string"))


_LINE = """
    SELECT category_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS icept, min(ds) AS start, max(ds) AS last_ds
    FROM (SELECT *, ds - min(ds) OVER (PARTITION BY category_id) AS t FROM series) GROUP BY 1 HAVING count(*) >= 14"""
_RESID = """
    SELECT s.category_id, isodow(ds) AS wd, y - icept - slope * (ds - start) AS r FROM series s JOIN line l USING (category_id)"""
_EFFECT = "SELECT category_id, wd, avg(r) AS effect FROM resid GROUP BY 1, 2"
_SIGMA = """
    SELECT r.category_id, sqrt(avg((r - effect) * (r - effect))) AS sigma FROM resid r JOIN effects e
    ON e.category_id = r.category_id AND e.wd = r.wd GROUP BY 1"""


@query("volume_forecast_seasonal", over("series", """
    SELECT category_id, CAST(day AS VARCHAR) AS forecast_date, round(greatest(yhat, 0), 6) AS predicted_count,
        round(greatest(yhat - 1.2816 * sigma, 0), 6) AS lower_bound, round(yhat + 1.2816 * sigma, 6) AS upper_bound,
        'high' AS confidence
    FROM (SELECT l.category_id, l.last_ds + step AS day, icept + slope * (l.last_ds + step - start) + effect AS yhat, sigma
        FROM line l JOIN (SELECT unnest([1, 2, 3]) AS step) ON true
        JOIN effects e ON e.category_id = l.category_id AND e.wd = isodow(l.last_ds + step)
        JOIN sigmas g ON g.category_id = l.category_id)""",
    line=_LINE, resid=_RESID, effects=_EFFECT, sigmas=_SIGMA))
def _(spark, sf):
    rows = forecast.forecast_seasonal(series(spark, sf), digits=None)
    rows = rounded(rows, "predicted_count", "lower_bound", "upper_bound")
    return rows.withColumn("forecast_date", F.col("forecast_date").cast("string"))


@query("forecast_backtest", over("series", """
    SELECT round(coalesce(avg(rmse), 0), 6) AS rmse, round(coalesce(avg(mape), 0), 6) AS mape,
        (SELECT count(DISTINCT category_id) FROM series) AS n_categories
    FROM (SELECT category_id, sqrt(avg((y - mean) * (y - mean))) AS rmse,
            avg(abs((y - mean) / CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE y END)) * 100 AS mape
        FROM numbered JOIN (SELECT category_id, avg(y) AS mean FROM numbered WHERE back > 3 AND back <= 17 GROUP BY 1)
            USING (category_id)
        WHERE back <= 3 AND size > 17 GROUP BY 1)"""))
def _(spark, sf):
    return rounded(forecast.backtest(series(spark, sf)), "rmse", "mape")


# --- models ---------------------------------------------------------------------------------
@query("rule_profiles", over("user_features", "SELECT user_id, profile FROM rule_profiles"))
def _(spark, sf):
    return models.rule_profiles(user_features(spark, sf)).select("user_id", "profile")


@query("classify_users")
def _(spark, sf):
    rows = tb.tickets(spark, sf, *USER_INPUT)
    users = cut_lineage(features.user_features(rows))
    model = models.train_profiles(users, rows.count())
    return models.predict_profiles(model, users).select("user_id", "profile", "confidence")


@query("sla_risk_scores", over("sla_features", """
    SELECT technician_id, round_even(rate, 4) AS risk_score, CAST(rate >= 0.5 AS INTEGER) AS next_48h_prediction,
        'low' AS confidence
    FROM sla_features, (SELECT avg(sla_violation) AS rate FROM sla_features)"""))
def _(spark, sf):
    # every technician of the test data has a violation: a single class, hence the base rate
    rows = tb.tickets(spark, sf, *SLA_INPUT)
    technicians = features.sla_features(rows, timestamp(NOW))
    return models.predict_risk(models.train_risk(technicians, rows.count()), technicians)


_SCORED = "SELECT quality AS p, toxic AS t, n_chars AS s FROM labels JOIN documents USING (doc_id)"


@query("classification_metrics", f"""
    WITH d AS ({_SCORED}),
    lab AS (SELECT l, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t = l) AS a, count(*) FILTER (p = l) AS g
        FROM d, (SELECT unnest([0, 1]) AS l) WHERE t = l OR p = l GROUP BY 1),
    ranked AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM d),
    sums AS (SELECT sum(r) FILTER (t = 1) AS rs, count(*) FILTER (t = 1) AS np, count(*) FILTER (t <> 1) AS nn FROM ranked)
    SELECT (SELECT round(avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM d) AS accuracy,
        (SELECT round(avg(coalesce(2.0::DOUBLE * tp / nullif(a + g, 0), 0)), 6) FROM lab) AS f1_macro,
        (SELECT round(2.0::DOUBLE * tp / (a + g), 6) FROM lab WHERE l = 1) AS f1,
        (SELECT round((rs - np * (np + 1) / 2.0::DOUBLE) / (np * nn), 6) FROM sums) AS auc,
        (SELECT count(*) FROM d) AS n""")
def _(spark, sf):
    docs = tb.table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = tb.table(spark, sf, "labels").join(docs, "doc_id")
    out = metrics.classification_metrics(scored, "toxic", "quality", "n_chars")
    return rounded(out, "accuracy", "f1_macro", "f1", "auc")
