"""User profiles and SLA risk: rules, MLlib pipelines and their fallbacks."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.features import SLA_FEATURES, USER_FEATURES

# Profile names in order of their label number.
PROFILES = ("autonome", "critique", "dependant", "standard")
COLD_START = 100   # tickets needed before a model is trained
SEED = 42
TREES = 200
MIN_TECHNICIANS = 5


# --- profiles -------------------------------------------------------------------------------
def profile_rule() -> Column:
    """First rule that holds: critique, dependant, autonome, else standard."""
    total, high = F.col("total_tickets"), F.col("high_priority_count")
    zero = F.lit(0.0)
    high_ratio = F.coalesce(F.try_divide(high, total), zero)
    resolved_ratio = F.coalesce(F.try_divide(F.col("resolved_count"), total), zero)
    critical = (high_ratio >= 0.30) | ((high >= 3) & (F.col("avg_resolution_days") >= 5))
    leaning = (
        (F.col("tickets_per_month") >= 4) | (F.col("repetitive_count") >= 5) | (total >= 20)
    )
    light = (total <= 5) & (resolved_ratio >= 0.8) & (high == 0)
    return (
        F.when(critical, "critique")
        .when(leaning, "dependant")
        .when(light, "autonome")
        .otherwise("standard")
    )


def rule_profiles(features: DataFrame) -> DataFrame:
    """user_id, profile by rule (confidence 1) and the features it came from."""
    return features.select(
        "user_id",
        profile_rule().alias("profile"),
        F.lit(1.0).alias("confidence"),
        F.struct(*USER_FEATURES).alias("features_snapshot"),
    )


def _as_features(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def _label_number(profile: Column) -> Column:
    number = F.when(profile == PROFILES[0], 0.0)
    for i, name in enumerate(PROFILES[1:], start=1):
        number = number.when(profile == name, float(i))
    return number


def train_profiles(features: DataFrame, n_tickets: int, trees: int = TREES) -> PipelineModel | None:
    """Random forest on the rule labels, classes weighted to balance; None on a cold start.

    The rows are dealt out evenly by user, in order, so the draws do not depend on how they came.
    Each row keeps the node it has reached in every tree; otherwise each level walks all trees
    from their roots again, which is most of the time where trees are deep.
    """
    if n_tickets < COLD_START:
        return None
    data = _as_features(features, USER_FEATURES).withColumn("label", _label_number(profile_rule()))
    # at most four rows
    counts = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if not counts:
        return None
    n = sum(counts.values())
    weight = F.lit(0.0)
    for label, count in counts.items():
        weight = F.when(F.col("label") == label, n / (len(counts) * count)).otherwise(weight)
    stages = [
        VectorAssembler(inputCols=[f"x_{c}" for c in USER_FEATURES], outputCol="features"),
        RandomForestClassifier(
            numTrees=trees, maxDepth=30, weightCol="w", seed=SEED, featureSubsetStrategy="sqrt",
            cacheNodeIds=True, checkpointInterval=-1,
        ),
    ]
    tasks = 2 * data.sparkSession.sparkContext.defaultParallelism
    dealt = data.withColumn("w", weight).repartition(tasks, "user_id").sortWithinPartitions("user_id")
    return Pipeline(stages=stages).fit(dealt)


def predict_profiles(model: PipelineModel, features: DataFrame) -> DataFrame:
    scored = model.transform(_as_features(features, USER_FEATURES))
    names = F.array(*[F.lit(p) for p in PROFILES])
    return scored.select(
        "user_id",
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("profile"),
        F.bround(F.array_max(vector_to_array("probability")), 4).alias("confidence"),
        F.struct(*USER_FEATURES).alias("features_snapshot"),
    )


def profile_predictions(model: PipelineModel, features: DataFrame) -> DataFrame:
    """(truth, predicted) against the rules, for evaluation."""
    named = predict_profiles(model, features).select("user_id", F.col("profile").alias("predicted"))
    return features.select("user_id", profile_rule().alias("truth")).join(named, "user_id")


# --- SLA risk -------------------------------------------------------------------------------
def risk_base_rate(features: DataFrame) -> DataFrame:
    """One row: part of technicians with a violation, their number, number of classes."""
    return features.agg(
        F.coalesce(F.avg(F.col("sla_violation").cast("double")), F.lit(0.0)).alias("base_rate"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("sla_violation").alias("classes"),
    )


def fallback_risk(features: DataFrame) -> DataFrame:
    """Base rate for everyone, confidence low."""
    rate = risk_base_rate(features).select("base_rate").scalar()
    return _risk_rows(features.withColumn("score", rate), "low")


def _risk_rows(scored: DataFrame, confidence: str) -> DataFrame:
    return scored.select(
        "technician_id",
        F.bround("score", 4).alias("risk_score"),
        (F.col("score") >= 0.5).cast("int").alias("next_48h_prediction"),
        F.lit(confidence).alias("confidence"),
    )


def train_risk(features: DataFrame, n_tickets: int) -> PipelineModel | None:
    """Gradient-boosted trees; None when a single class or too few rows leave only the base rate."""
    if n_tickets < COLD_START:
        return None
    base = risk_base_rate(features).first()
    if base["classes"] < 2 or base["n"] < MIN_TECHNICIANS:
        return None
    data = _as_features(features, SLA_FEATURES).withColumn("label", F.col("sla_violation").cast("double"))
    stages = [
        VectorAssembler(inputCols=[f"x_{c}" for c in SLA_FEATURES], outputCol="features"),
        GBTClassifier(
            maxIter=150, maxDepth=4, stepSize=0.1, subsamplingRate=0.9, seed=SEED,
            featureSubsetStrategy="0.9",
        ),
    ]
    return Pipeline(stages=stages).fit(data)


def predict_risk(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    if model is None:
        return fallback_risk(features)
    scored = model.transform(_as_features(features, SLA_FEATURES))
    return _risk_rows(scored.withColumn("score", vector_to_array("probability")[1]), "high")
