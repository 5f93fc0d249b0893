"""Scores of predictions and choice of penalties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pearson


def _scores(y: Column, p: Column, base: Column) -> list[Column]:
    sse, ref = F.sum((y - p) * (y - p)), F.sum((y - base) * (y - base))
    return [
        F.count("*").alias("n"),
        pearson(y, p).alias("pcc"),
        F.sqrt(sse / F.count("*")).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(sse, F.nullif(ref, F.lit(0.0)))).alias("q2_train_mean"),
    ]


def scores(pred: DataFrame, *keys: str) -> DataFrame:
    """A11 by keys: n, pcc, rmse, mae, q2_train_mean (null where undefined).  Columns y, prediction, train_mean."""
    return pred.groupBy(*keys).agg(*_scores(F.col("y"), F.col("prediction"), F.col("train_mean")))


def with_mean_model(pred: DataFrame, name: str = "additive_krr") -> DataFrame:
    """Each prediction twice: the model's, and the training mean as a model of its own."""
    rows = F.inline(F.array(F.struct(F.lit(name).alias("model"), F.col("prediction").alias("value")), F.struct(F.lit("train_mean").alias("model"), F.col("train_mean").alias("value"))))
    others = [c for c in pred.columns if c != "prediction"]
    return pred.select(*others, rows).withColumnRenamed("value", "prediction")


def pooled_and_by_fold(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The scores over all folds (fold null) and by fold, in one pass over grouping sets."""
    view = pred.groupingSets([list(keys), [*keys, "fold"]], *keys, "fold")
    y, p = F.col("y"), F.col("prediction")
    r2 = (1 - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0)))).alias("r2")
    return view.agg(*_scores(y, p, F.col("train_mean")), F.avg((y - p) * (y - p)).alias("mse"), r2)


def ladder_metrics(pred: DataFrame) -> DataFrame:
    """Pooled scores and the range of marker counts by strategy and budget."""
    y, p = F.col("y"), F.col("prediction")
    return pred.groupBy("strategy", "budget").agg(
        F.avg((y - p) * (y - p)).alias("pooled_mse"),
        pearson(y, p).alias("pcc"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0)))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.min("actual_markers").alias("actual_markers_min"),
        F.max("actual_markers").alias("actual_markers_max"),
    )


def pooled_sse(errors: DataFrame, *keys: str) -> DataFrame:
    """Summed squared errors of the inner splits by workflow and penalty."""
    return errors.groupBy(*keys, "penalty_idx", "penalty").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))


def best_penalty(sse: DataFrame, *keys: str) -> DataFrame:
    """A10: least error, the first of the grid on ties; inner_mse and whether it stands at the grid's border."""
    grid = sse.groupBy(*keys).agg(F.min("penalty").alias("lo"), F.max("penalty").alias("hi"), F.min_by(F.struct("penalty", "sse", "n"), F.struct("sse", "penalty_idx")).alias("b"))
    return grid.select(*keys, F.col("b.penalty").alias("penalty"), (F.col("b.sse") / F.col("b.n")).alias("inner_mse"), ((F.col("b.penalty") == F.col("lo")) | (F.col("b.penalty") == F.col("hi"))).alias("boundary"))


def weighted_comparison(own: DataFrame, published: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fold-weighted mean MSE of both, relative gain, folds improved; joined by fold."""
    j = own.select("model", "fold", F.col("mse").alias("own_mse")).join(published.select("fold", F.col("mse").alias("their_mse")), "fold").join(sizes, "fold")
    n = F.sum("n")
    a, b = F.sum(F.col("n") * F.col("own_mse")) / n, F.sum(F.col("n") * F.col("their_mse")) / n
    return j.groupBy("model").agg(a.alias("own_mse"), b.alias("published_mse"), (1 - a / b).alias("relative_gain"), F.count_if(F.col("own_mse") < F.col("their_mse")).alias("improved_folds"))
