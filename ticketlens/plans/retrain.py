"""The training job: fit, evaluate, and keep the better of new and current model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.ids import content_fingerprint
from ticketlens.functions.text import clean_tokens
from ticketlens.operators import clustering, features, forecast, metrics, models
from ticketlens.session import cut_lineage

# What decides a promotion, and whether more is better.
PRIMARY = {
    "classifier": ("f1_macro", True),
    "sla_risk": ("f1", True),
    "forecaster": ("mape", False),
    "clusterer": ("silhouette", True),
}
_LAYOUT = "model string, version int, metric string, value double, promoted boolean, input_hash string"


def promotes(new: float, current: float | None, higher_is_better: bool) -> bool:
    """The first model always; afterwards a tie or an improvement."""
    if current is None:
        return True
    return new >= current if higher_is_better else new <= current


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def history(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/model_history"
    if not _exists(spark, path):
        return spark.createDataFrame([], _LAYOUT)
    return spark.read.schema(_LAYOUT).parquet(path)


def _pipeline_path(root: str, model: str, version: int) -> str:
    return f"{root}/models/{model}/version={version:06d}"


def current_model(spark: SparkSession, root: str, model: str) -> PipelineModel | None:
    """The pipeline promoted last; None before the first, or where that version has none."""
    promoted = history(spark, root).filter((F.col("model") == model) & F.col("promoted"))
    version = promoted.agg(F.max("version")).first()[0]
    if version is None or not _exists(spark, _pipeline_path(root, model, version)):
        return None
    return PipelineModel.load(_pipeline_path(root, model, version))


def _record(spark, root, model: str, figures: dict[str, float], input_hash: str, saved) -> dict:
    """Compare with the promoted version, append the metrics, save the pipeline if there is one."""
    known = history(spark, root).filter(F.col("model") == model)
    metric, higher = PRIMARY[model]
    # a handful of rows per training run
    current = (
        known.filter(F.col("promoted") & (F.col("metric") == metric))
        .orderBy(F.desc("version")).limit(1).collect()
    )
    last = known.agg(F.max("version")).first()[0] or 0
    version = last + 1
    promoted = promotes(figures.get(metric, 0.0), current[0]["value"] if current else None, higher)
    if saved is not None:
        saved.write().overwrite().save(_pipeline_path(root, model, version))
    rows = [(model, version, name, float(v), promoted, input_hash) for name, v in figures.items()]
    spark.createDataFrame(rows, _LAYOUT).coalesce(1).write.mode("append").parquet(
        f"{root}/model_history"
    )
    return {"model": model, "version": version, "promoted": promoted, **figures}


def _single(df: DataFrame) -> dict[str, float]:
    return {k: float(v) for k, v in df.first().asDict().items()}


def retrain(
    tickets: DataFrame, now: Column, root: str, only=tuple(PRIMARY), trees: int = models.TREES,
    silhouette: str = "sums",
) -> list[dict]:
    """Train and evaluate the named models on ``tickets``; returns one summary per model.

    ``silhouette`` chooses the clusterer's promotion measure: ``sums`` (squared distances from
    per-cluster statistics, linear in the tickets) or ``exact`` (Euclidean, all pairs).
    """
    spark = tickets.sparkSession
    n_tickets = tickets.count()
    fingerprint = content_fingerprint(tickets).first()["fingerprint"]
    out = []
    if "classifier" in only:
        users = cut_lineage(features.user_features(tickets))
        model = models.train_profiles(users, n_tickets, trees)
        if model is None:
            out.append({"model": "classifier", "promoted": False, "reason": "cold_start"})
        else:
            scored = cut_lineage(models.profile_predictions(model, users))
            figures = _single(metrics.accuracy_and_f1(scored, "truth", "predicted"))
            figures["n_users"] = figures.pop("n")
            out.append(_record(spark, root, "classifier", figures, fingerprint, model))
    if "sla_risk" in only:
        technicians = cut_lineage(features.sla_features(tickets, now))
        if n_tickets < models.COLD_START:
            out.append({"model": "sla_risk", "promoted": False, "reason": "cold_start"})
        else:
            model = models.train_risk(technicians, n_tickets)
            risk = models.predict_risk(model, technicians)
            scored = cut_lineage(technicians.select("technician_id", "sla_violation").join(risk, "technician_id"))
            figures = _single(
                metrics.classification_metrics(
                    scored, "sla_violation", "next_48h_prediction", "risk_score"
                )
            )
            figures["n_techs"] = figures.pop("n")
            figures.pop("f1_macro")
            out.append(_record(spark, root, "sla_risk", figures, fingerprint, model))
    if "forecaster" in only:
        series = cut_lineage(features.daily_category_counts(tickets))
        figures = _single(forecast.backtest(series, forecast.forecast_seasonal))
        out.append(_record(spark, root, "forecaster", figures, fingerprint, None))
    if "clusterer" in only:
        corpus = features.text_corpus(tickets)
        vectors = cut_lineage(clustering.text_vectors(corpus, clean_tokens(F.col("text"))))
        labels = cut_lineage(clustering.dbscan(vectors))
        figures = _single(clustering.cluster_counts(labels))
        figures["silhouette"] = _silhouette(vectors, labels, figures["n_clusters"], silhouette)
        out.append(_record(spark, root, "clusterer", figures, fingerprint, None))
    return out


def _silhouette(vectors: DataFrame, labels: DataFrame, n_clusters: float, how: str) -> float:
    if how not in ("sums", "exact"):
        raise ValueError(f"silhouette is 'sums' or 'exact', not {how!r}")
    if n_clusters < 2:
        return 0.0
    measure = clustering.silhouette_sums if how == "sums" else clustering.silhouette
    return float(measure(vectors, labels).first()["silhouette"])


if __name__ == "__main__":  # spark-submit retrain.py <warehouse root> <now>
    import sys

    from ticketlens.operators.filters import timestamp
    from ticketlens.session import build_session
    from ticketlens.sources.warehouse import Warehouse

    session = build_session("retrain")
    fact = Warehouse(session, sys.argv[1]).read("dim_tickets_enriched")
    print(retrain(fact, timestamp(sys.argv[2]), sys.argv[1]))
