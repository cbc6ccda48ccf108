"""Daily volume forecasts per category: all series in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the two models.
TRAILING_DAYS = 14
AVERAGE_Z = 1.96       # normal quantile of a 95 % interval
SEASONAL_Z = 1.2816    # normal quantile of an 80 % interval
HORIZON = 3


def _from_newest():
    """Position of a point counted from the end of its series."""
    return F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("ds")))


def trailing_stats(series: DataFrame, days: int = TRAILING_DAYS) -> DataFrame:
    """Mean and population deviation of each series' last ``days`` points."""
    return (
        series.withColumn("_n", _from_newest())
        .filter(F.col("_n") <= days)
        .groupBy("category_id")
        .agg(
            F.avg("y").alias("mean"),
            F.stddev_pop("y").alias("std"),
            F.max("ds").alias("last_ds"),
        )
    )


def _ahead(df: DataFrame, horizon: int) -> DataFrame:
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return df.withColumn("_step", F.explode(steps)).withColumn(
        "forecast_date", F.date_add(F.col("last_ds"), F.col("_step"))
    )


def _bounded(df: DataFrame, z: float, confidence: str, digits: int | None = 2) -> DataFrame:
    def shown(c):
        return c if digits is None else F.bround(c, digits)

    low = F.greatest(F.col("yhat") - z * F.col("sigma"), F.lit(0.0))
    return df.select(
        "category_id", "forecast_date",
        shown(F.greatest(F.col("yhat"), F.lit(0.0))).alias("predicted_count"),
        shown(low).alias("lower_bound"),
        shown(F.col("yhat") + z * F.col("sigma")).alias("upper_bound"),
        F.lit(confidence).alias("confidence"),
    )


def forecast_average(series: DataFrame, horizon: int = HORIZON, digits: int | None = 2) -> DataFrame:
    """Trailing mean, constant over the horizon."""
    stats = trailing_stats(series).withColumnsRenamed({"mean": "yhat", "std": "sigma"})
    return _bounded(_ahead(stats, horizon), AVERAGE_Z, "low", digits)


def forecast_seasonal(series: DataFrame, horizon: int = HORIZON, digits: int | None = 2) -> DataFrame:
    """Linear trend plus weekday effect, closed form; needs ``TRAILING_DAYS`` points.

    A substitute for an iterative trend-and-seasonality fit: least-squares line, then the mean
    residual of each weekday, then the deviation of what is left.
    """
    whole = Window.partitionBy("category_id")  # one row per day: bounded by the calendar
    t = F.datediff(F.col("ds"), F.col("first_ds"))
    dated = series.withColumn("first_ds", F.min("ds").over(whole)).withColumn("t", t)
    line = dated.groupBy("category_id").agg(
        F.regr_slope("y", "t").alias("slope"),
        F.regr_intercept("y", "t").alias("intercept"),
        F.min("ds").alias("start"), F.max("ds").alias("last_ds"),
        F.count(F.lit(1)).alias("n"),
    ).filter(F.col("n") >= TRAILING_DAYS)
    residual = F.col("y") - F.col("intercept") - F.col("slope") * F.col("t")
    fitted = dated.join(line, "category_id").select(
        "category_id", F.weekday("ds").alias("wd"), residual.alias("r")
    )
    weekday = fitted.groupBy("category_id", "wd").agg(
        F.avg("r").alias("effect"), F.var_pop("r").alias("spread"), F.count(F.lit(1)).alias("m")
    )
    # the left-over variance is the weighted mean of the within-weekday variances
    sigma = weekday.groupBy("category_id").agg(
        F.sqrt(F.sum(F.col("spread") * F.col("m")) / F.sum("m")).alias("sigma")
    )
    ahead = _ahead(line, horizon).withColumn("wd", F.weekday("forecast_date"))
    rows = ahead.join(weekday.select("category_id", "wd", "effect"), ["category_id", "wd"]).join(
        sigma, "category_id"
    )
    t_ahead = F.datediff(F.col("forecast_date"), F.col("start"))
    yhat = F.col("intercept") + F.col("slope") * t_ahead + F.col("effect")
    return _bounded(rows.withColumn("yhat", yhat), SEASONAL_Z, "high", digits)


def forecast_volume(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Seasonal model where a series is long enough, else the trailing mean."""
    seasonal = forecast_seasonal(series, horizon)
    known = series.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    short = known.filter(F.col("n") < TRAILING_DAYS).select("category_id")
    average = forecast_average(series.join(short, "category_id", "left_semi"), horizon)
    return seasonal.unionByName(average)


def holdout_split(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Tag each point as ``train`` or ``test`` (the last ``horizon`` points of its series)."""
    return series.withColumn("_n", _from_newest()).select(
        "category_id", "ds", "y",
        F.when(F.col("_n") <= horizon, "test").otherwise("train").alias("part"),
    )


def backtest(series: DataFrame, model=forecast_average, horizon: int = HORIZON) -> DataFrame:
    """Mean RMSE and MAPE over the held-out ends of all series long enough."""
    size = Window.partitionBy("category_id")
    parts = holdout_split(series, horizon).withColumn("_size", F.count(F.lit(1)).over(size))
    usable = parts.filter(F.col("_size") > horizon + TRAILING_DAYS)
    predicted = model(usable.filter(F.col("part") == "train").select("category_id", "ds", "y"),
                      horizon, None)
    truth = usable.filter(F.col("part") == "test").select("category_id", "ds", "y")
    error = F.col("y") - F.col("predicted_count")
    base = F.when(F.col("y") == 0, 1.0).otherwise(F.col("y").cast("double"))
    per_series = (
        truth.join(
            predicted.select("category_id", F.col("forecast_date").alias("ds"), "predicted_count"),
            ["category_id", "ds"],
        )
        .groupBy("category_id")
        .agg(
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (F.avg(F.abs(error / base)) * 100.0).alias("mape"),
        )
    )
    n_series = series.agg(F.count_distinct("category_id")).scalar()
    return per_series.agg(
        F.coalesce(F.avg("rmse"), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.avg("mape"), F.lit(0.0)).alias("mape"),
    ).withColumn("n_categories", n_series)


def peak_and_mean(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("category_id").agg(
        F.max("predicted_count").alias("peak"), F.avg("predicted_count").alias("mean")
    )
