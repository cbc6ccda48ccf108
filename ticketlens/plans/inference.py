"""The scoring job: profiles, forecast, risk, clusters, recommendations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.text import clean_tokens
from ticketlens.operators import clustering, features, forecast, models, recommend, rollups
from ticketlens.plans.retrain import current_model
from ticketlens.session import cut_lineage
from ticketlens.sources.warehouse import Warehouse


def cluster_tickets(tickets: DataFrame, algorithm: str = "dbscan", **options) -> DataFrame:
    """Label and summarise ticket texts."""
    corpus = cut_lineage(features.text_corpus(tickets))
    vectors = clustering.text_vectors(corpus, clean_tokens(F.col("text")))
    run = clustering.kmeans if algorithm == "kmeans" else clustering.dbscan
    labels = run(vectors, **options)
    return clustering.cluster_summary(corpus.join(labels, "id"), algorithm)


def infer(
    tickets: DataFrame,
    now: Column,
    rules: recommend.Rules = recommend.Rules(),
    profile_model: PipelineModel | None = None,
    risk_model: PipelineModel | None = None,
    trees: int = models.TREES,
) -> dict[str, DataFrame]:
    """All result tables. Feature frames are materialised once and shared by the models."""
    users = cut_lineage(features.user_features(tickets))
    technicians = cut_lineage(features.sla_features(tickets, now))
    n_tickets = tickets.count()
    profile_model = profile_model or models.train_profiles(users, n_tickets, trees)
    if profile_model is None:
        # cold start: no model, no profiles
        profiles = models.rule_profiles(users).limit(0)
    else:
        profiles = models.predict_profiles(profile_model, users)
    risk_model = risk_model or models.train_risk(technicians, n_tickets)
    risk = models.predict_risk(risk_model, technicians)
    if n_tickets < models.COLD_START:
        risk = risk.limit(0)
    series = cut_lineage(features.daily_category_counts(tickets))
    forecasts = forecast.forecast_volume(series)
    clusters = cut_lineage(cluster_tickets(tickets))
    profiles = cut_lineage(profiles)
    fallback = rollups.global_sla_pct(tickets)
    recos = recommend.recommendations(
        profiles=profiles,
        concentration=features.incident_concentration(tickets),
        forecasts=forecasts,
        team_sla=features.team_sla(technicians, fallback),
        clusters=clusters,
        now=now,
        rules=rules,
    )
    return {
        "ml_user_profiles": profiles,
        "ml_forecasts": forecasts,
        "ml_sla_risk": risk,
        "ml_clusters": clusters,
        "recommendations": recos,
    }


def run(
    spark: SparkSession, root: str, now: Column, version: str = "",
    rules: recommend.Rules = recommend.Rules(),
) -> dict[str, int]:
    """Score the warehouse below ``root`` and merge the results into it.

    Models that retraining has promoted there are loaded; without one it is trained on the fly.
    Cluster numbers are dealt anew in each run, so clusters replace those of their algorithm.
    """
    warehouse = Warehouse(spark, root)
    warehouse.ensure_schema()
    tickets = warehouse.read("dim_tickets_enriched")
    if rollups.freshness_count(tickets, now).first()["recent"] == 0:
        print("no tickets modified in the last 24 h - scoring the whole table")
    out = {}
    results = infer(
        tickets, now, rules,
        profile_model=current_model(spark, root, "classifier"),
        risk_model=current_model(spark, root, "sla_risk"),
    )
    for table, rows in results.items():
        if table in ("ml_forecasts", "ml_sla_risk"):
            rows = rows.withColumn("model_version", F.lit(version))
        if table == "ml_clusters":
            out[table] = warehouse.replace(table, rows, now, "algorithm", ["dbscan"])
        else:
            out[table] = warehouse.upsert(table, rows, now)
    return out


if __name__ == "__main__":  # spark-submit inference.py <warehouse root> <now> [rules file]
    import sys

    from ticketlens.operators.filters import timestamp
    from ticketlens.session import build_session

    chosen = recommend.load_rules(sys.argv[3] if len(sys.argv) > 3 else None)
    run(build_session("inference"), sys.argv[1], timestamp(sys.argv[2]), rules=chosen)
