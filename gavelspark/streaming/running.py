"""Extension: running accuracy over completions that arrive as a stream (the batch operators have no counterpart of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.text import boxed_text_eval


def running_accuracy(completions: DataFrame, truth: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Answers, verdicts and right answers per window of ``arrived`` of a stream (list_id, k, text, arrived).

    A completion delivered again within the watermark counts once. ``truth`` (list_id, chosen_answer) is a static
    table; whether it is broadcast is left to its size.
    """
    once = completions.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["list_id", "k"])
    judged = once.withColumn("answer", boxed_text_eval(F.col("text"))).join(truth, "list_id")
    right = F.coalesce(F.col("answer") == F.col("chosen_answer"), F.lit(False))
    return judged.groupBy(F.window("arrived", window)).agg(F.count("*").alias("answers"), F.count("answer").alias("verdicts"), F.count_if(right).alias("right"))
