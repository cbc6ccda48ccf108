"""Behaviour, SLA and text features of the ticket fact."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import measures as m
from ticketlens.functions.text import ticket_text

USER_FEATURES = (
    "total_tickets", "incidents_count", "requests_count", "resolved_count", "open_count",
    "high_priority_count", "repetitive_count", "avg_resolution_days", "tickets_per_month",
)
SLA_FEATURES = (
    "current_open_tickets", "tickets_last_7_days", "avg_resolution_days_last_30_days",
    "high_priority_ratio", "historical_sla_pct",
)
REPETITIVE_MIN = 3  # fixed value: a title seen this often is repetitive
MIN_CHARS = 3


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def user_features(tickets: DataFrame) -> DataFrame:
    """Nine features per requester.

    Tickets are first counted per (requester, title), then per requester, so one busy requester
    or title is combined before each shuffle.
    """
    resolved = m.is_resolved(F.col("status"))
    days = F.when(resolved, F.col("resolution_days"))
    by_title = (
        tickets.filter(F.col("user_requester").isNotNull())
        .groupBy(F.col("user_requester").alias("user_id"), "name_normalized")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(_yes(F.col("type") == m.INCIDENT)).alias("incidents"),
            F.count_if(_yes(F.col("type") == m.REQUEST)).alias("requests"),
            F.count_if(resolved).alias("resolved"),
            F.count_if(m.is_high_priority(F.col("priority"))).alias("high"),
            F.sum(m.day_micros(days)).alias("day_sum"),
            F.count(days).alias("day_n"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
        )
    )
    repeated = _yes(F.col("name_normalized") != "") & (F.col("n") >= REPETITIVE_MIN)
    total = F.sum("n")
    return by_title.groupBy("user_id").agg(
        total.alias("total_tickets"),
        F.sum("incidents").alias("incidents_count"),
        F.sum("requests").alias("requests_count"),
        F.sum("resolved").alias("resolved_count"),
        (total - F.sum("resolved")).alias("open_count"),
        F.sum("high").alias("high_priority_count"),
        F.sum(F.when(repeated, F.col("n")).otherwise(F.lit(0))).alias("repetitive_count"),
        F.coalesce(m.mean_of_micros(F.sum("day_sum"), F.sum("day_n")), F.lit(0.0)).alias(
            "avg_resolution_days"
        ),
        F.bround(total / m.months_active(F.min("first"), F.max("last")), 3).alias(
            "tickets_per_month"
        ),
    )


def repetitive_titles(tickets: DataFrame) -> DataFrame:
    """Per requester: tickets under titles that the requester used at least three times."""
    titled = tickets.filter(
        F.col("user_requester").isNotNull() & _yes(F.col("name_normalized") != "")
    )
    counts = titled.groupBy(F.col("user_requester").alias("user_id"), "name_normalized").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("user_id").agg(
        F.sum(F.when(F.col("n") >= REPETITIVE_MIN, F.col("n")).otherwise(F.lit(0))).alias(
            "repetitive_count"
        )
    )


def sla_features(tickets: DataFrame, now: Column, past_deadline_only: bool = False) -> DataFrame:
    """Five SLA features and the violation label per technician, in one aggregation."""
    resolved = m.is_resolved(F.col("status"))
    violated = m.sla_violated(
        F.col("solvedate"), F.col("closedate"), F.col("time_to_resolve"),
        now if past_deadline_only else None,
    )

    def since(days: int) -> Column:
        return _yes(F.col("date") >= now - F.make_dt_interval(F.lit(days)))

    kept = F.when(resolved, F.when(violated, 0.0).otherwise(1.0))
    return (
        tickets.filter(F.col("user_assign").isNotNull())
        .groupBy(F.col("user_assign").alias("technician_id"))
        .agg(
            F.count_if(~resolved).alias("current_open_tickets"),
            F.count_if(since(7)).alias("tickets_last_7_days"),
            F.coalesce(
                m.mean_days(F.when(since(30) & resolved, F.col("resolution_days"))), F.lit(0.0)
            ).alias("avg_resolution_days_last_30_days"),
            F.bround(m.share(m.is_high_priority(F.col("priority"))), 4).alias("high_priority_ratio"),
            F.bround(F.coalesce(F.avg(kept) * 100.0, F.lit(100.0)), 2).alias("historical_sla_pct"),
            F.max(violated.cast("int")).alias("sla_violation"),
        )
    )


def team_sla(features: DataFrame, fallback: DataFrame) -> DataFrame:
    """Mean historical SLA over technicians, else the single value of ``fallback``."""
    return features.agg(
        F.coalesce(F.avg("historical_sla_pct"), fallback.scalar()).alias("team_sla_pct")
    )


def incident_concentration(tickets: DataFrame, max_categories: int = 2) -> DataFrame:
    """Per requester: part of the incidents on the most frequent categories, and which."""
    counts = (
        tickets.filter(
            F.col("user_requester").isNotNull()
            & (F.col("type") == m.INCIDENT)
            & F.col("itilcategories_id").isNotNull()
        )
        .groupBy(F.col("user_requester").alias("user_id"), F.col("itilcategories_id").alias("cat"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("user_id").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "cat")
    leading = (
        counts.withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= max_categories)
        .groupBy("user_id")
        .agg(
            F.sum("n").alias("top_n"),
            F.sort_array(F.collect_list(F.struct("pos", "cat"))).getField("cat").alias("categories"),
        )
    )
    return leading.join(totals, "user_id").select(
        "user_id", (F.col("top_n") / F.col("total") * 100.0).alias("pct"), "categories"
    )


def top_n_categories(tickets: DataFrame, n: int = 10) -> DataFrame:
    return (
        tickets.filter(F.col("itilcategories_id").isNotNull())
        .groupBy(F.col("itilcategories_id").alias("category_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category_id")
        .limit(n)
    )


def daily_category_counts(tickets: DataFrame, top_n: int = 10) -> DataFrame:
    """Daily counts of the biggest categories, zero-filled from first to last day of each."""
    dated = tickets.filter(F.col("date").isNotNull() & F.col("itilcategories_id").isNotNull())
    daily = dated.groupBy(
        F.col("itilcategories_id").alias("category_id"), F.col("date").cast("date").alias("ds")
    ).agg(F.count(F.lit(1)).alias("y"))
    # all below works on (category, day) rows: the fact is read and shuffled once
    top = (
        daily.groupBy("category_id")
        .agg(F.sum("y").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"))
        .orderBy(F.desc("n"), "category_id")
        .limit(top_n)
    )
    calendar = top.select("category_id", F.explode(F.sequence("first", "last")).alias("ds"))
    return calendar.join(daily, ["category_id", "ds"], "left").select(
        "category_id", "ds", F.coalesce("y", F.lit(0).cast("bigint")).alias("y")
    )


def text_corpus(tickets: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, category, date and the text of each ticket long enough to be mined."""

    def column(name: str) -> Column:
        return F.col(name) if name in tickets.columns else F.lit(None).cast("string")

    return tickets.select(
        "id", column("itilcategories_id").alias("itilcategories_id"), column("date").alias("date"),
        ticket_text(column("name"), column("content")).alias("text"),
    ).filter(F.length("text") >= min_chars)


def feature_matrix(df: DataFrame, columns, output: str = "features") -> DataFrame:
    """Numeric feature vector; what is missing or not numeric counts as 0."""
    numeric = df.withColumns(
        {
            f"_x_{c}": F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
            if c in df.columns
            else F.lit(0.0)
            for c in columns
        }
    )
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol=output)
    return assembler.transform(numeric).drop(*[f"_x_{c}" for c in columns])
