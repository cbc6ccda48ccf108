"""Classification quality from confusion counts and ranked scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.ranking import ranges, running_sums
from ticketlens.session import cut_lineage


def _safe(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Counts per (truth, predicted): as small as the number of classes allows."""
    counted = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(counted.alias("n"))


def accuracy_and_f1(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """accuracy, f1_macro, n; an undefined F1 counts as 0. ``weight``: rows stand for that many."""
    cells = confusion(df, truth, predicted, weight)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("t").alias("label"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed")),
    )
    per_label = (
        cells.select(F.explode(sides).alias("s"))
        .groupBy("s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.actual").alias("actual"), F.sum("s.guessed").alias("guessed"))
    )
    f1 = _safe(2 * F.col("tp"), F.col("actual") + F.col("guessed"))
    return per_label.agg(
        _safe(F.sum("tp"), F.sum("actual")).alias("accuracy"),
        F.coalesce(F.avg(f1), F.lit(0.0)).alias("f1_macro"),
        F.coalesce(F.sum("actual"), F.lit(0)).alias("n"),
    )


def binary_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.agg(
        _safe(2 * F.count_if(t & p), F.count_if(t) + F.count_if(p)).alias("f1")
    )


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; 0 when a class is missing.

    Rows collapse to one per distinct score, then negatives below each score are summed over
    ranges of scores.
    """
    return _auc_of(
        df.groupBy(F.col(score).alias("score")).agg(
            F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
        )
    )


def _auc_of(totals: DataFrame) -> DataFrame:
    """AUC from (score, pos, neg), one row per distinct score."""
    # read three times below: for the ranges, their totals and the sums within
    by_score = cut_lineage(totals)
    ranked = running_sums(by_score, "score", {"neg_upto": "neg"}, ranges(by_score, "score"))
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(_safe(wins, pairs).alias("auc"))


def classification_metrics(df: DataFrame, truth: str, predicted: str, score: str) -> DataFrame:
    """accuracy, macro and binary F1, AUC and row count in one row, from one pass over ``df``.

    The rows are counted once per (truth, predicted, score); confusion, F1 and the AUC's score
    totals all come from that table, which is as small as the distinct scores allow.
    """
    cells = cut_lineage(
        df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p"), F.col(score).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    matrix = cells.groupBy("t", "p").agg(F.sum("n").alias("n"))
    base = accuracy_and_f1(matrix.withColumnRenamed("n", "_n"), "t", "p", weight="_n")
    yes_t, yes_p = F.col("t") == 1, F.col("p") == 1
    f1 = matrix.agg(
        _safe(
            2 * F.sum(F.when(yes_t & yes_p, F.col("n")).otherwise(0)),
            F.sum(F.when(yes_t, F.col("n")).otherwise(0)) + F.sum(F.when(yes_p, F.col("n")).otherwise(0)),
        )
    ).scalar()
    totals = cells.groupBy(F.col("s").alias("score")).agg(
        F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("t") != 1, F.col("n")).otherwise(0)).alias("neg"),
    )
    return base.withColumns({"f1": F.lit(f1), "auc": F.lit(_auc_of(totals).scalar())})
