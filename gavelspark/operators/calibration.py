"""Calibration of (conf, is_correct) rows; rows with a null in either are invalid and not measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bins(records: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, lo, hi, n, conf, acc) of equal-width bins, the first closed, others open below; empty bins are kept.

    Rows are reduced to one per bin before the (n_bins-row) edges are joined, so nothing but the bins is shuffled.
    Confidences outside [0, 1] are in no bin.
    """
    spark = records.sparkSession
    step = F.lit(1.0) / n_bins
    edges = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") * step).alias("lo"), F.when(F.col("id") == n_bins - 1, F.lit(1.0)).otherwise((F.col("id") + 1) * step).alias("hi"))
    conf = F.col("conf")
    guess = F.greatest(F.least(F.ceil(conf * n_bins) - 1, F.lit(n_bins - 1)), F.lit(0)).cast("int")
    # a product of floats may lie on the wrong side of an edge: compare with the edges themselves
    placed = F.when((guess > 0) & (conf <= guess * step), guess - 1).when((guess < n_bins - 1) & (conf > (guess + 1) * step), guess + 1).otherwise(guess)
    valid = records.where(conf.isNotNull() & F.col("is_correct").isNotNull() & conf.between(0.0, 1.0))
    per_bin = valid.groupBy(placed.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg(F.col("is_correct").cast("double")).alias("acc"))
    return edges.join(per_bin, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "conf", "acc")


def ece(records: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: expected calibration error; 0 without valid rows."""
    table = bins(records, n_bins)
    total = F.try_divide(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))), F.sum("n"))
    return table.agg(F.round(F.coalesce(total, F.lit(0.0)), 9).alias("ece"))


def brier(records: DataFrame) -> DataFrame:
    """One row: mean squared distance of confidence and outcome; NaN without valid rows."""
    return records.where("conf is not null and is_correct is not null").agg(F.round(F.coalesce(F.avg(F.pow(F.col("conf") - F.col("is_correct"), 2)), F.lit(float("nan"))), 9).alias("brier"))


def calibration_summary(records: DataFrame) -> DataFrame:
    """One row: all rows, valid rows, accuracy and mean confidence of the valid ones (0 without any)."""
    valid = F.col("conf").isNotNull() & F.col("is_correct").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(valid, c)), F.lit(0.0)), 9)
    return records.agg(F.count("*").alias("n_total"), F.count_if(valid).alias("n_valid"), mean(F.col("is_correct").cast("double")).alias("accuracy"), mean(F.col("conf")).alias("mean_conf"))
