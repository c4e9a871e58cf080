"""Problem 4: tokens per slice of a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.bpe import CountLattice


def counters(df: DataFrame, lattice: CountLattice):
    """Two functions, Column -> Column: tokens of a text and of an array of texts; null counts 0."""
    sent = df.sparkSession.sparkContext.broadcast(lattice)

    @F.pandas_udf("long")
    def of_text(texts: pd.Series) -> pd.Series:
        count = sent.value.count_text
        return pd.Series([count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    @F.pandas_udf("long")
    def of_texts(arrays: pd.Series) -> pd.Series:
        count = sent.value.count_text
        return pd.Series([sum(count(t) for t in a if isinstance(t, str)) if a is not None else 0 for a in arrays], dtype="int64")

    return of_text, of_texts


def canonical(language: Column, names: DataFrame, df: DataFrame, out: str) -> DataFrame:
    """``df`` with the canonical name of ``language`` in ``out``; an unknown spelling stays as it is, null stays null.

    ``names`` (spelling, canonical) is a fixed table; of a repeated spelling the first canonical name counts.
    """
    few = names.where(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.min("canonical").alias("__canonical"))
    joined = df.withColumn("__spelling", language).join(few.withColumnRenamed("spelling", "__key"), F.col("__spelling") == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__canonical", "__spelling")).drop("__spelling", "__key", "__canonical")


def token_budget(lists: DataFrame, names: DataFrame, lattice: CountLattice) -> DataFrame:
    """Tokens by (source, language, domain) of lists (list_id, query, candidates, source, language, domain, ingested_at).

    Each list_id counts once, with its earliest delivery (of equal times the one with fewer tokens); rows without
    list_id count one by one. Null source, language or domain is a slice of its own. Null or empty texts hold no
    token. An empty table gives no slice. Only counts are shuffled, after partial aggregation by slice.
    """
    of_text, of_texts = counters(lists, lattice)
    slim = lists.select("list_id", "source", "language", "domain", "ingested_at", of_text("query").alias("query_tokens"), of_texts("candidates").alias("candidate_tokens"))
    late = F.col("ingested_at").isNull()
    slim = slim.withColumn("alone", F.when(F.col("list_id").isNull(), F.monotonically_increasing_id()))
    fields = ["query_tokens", "candidate_tokens", "source", "language", "domain"]
    once = slim.groupBy("list_id", "alone").agg(F.min(F.struct(late.alias("late"), "ingested_at", *fields)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in fields])
    once = canonical(F.col("language"), names, once, "language")
    tokens = [F.sum(c).alias(c) for c in ("query_tokens", "candidate_tokens")]
    total = F.sum(F.col("query_tokens") + F.col("candidate_tokens")).alias("tokens")
    return once.groupBy("source", "language", "domain").agg(F.count("*").alias("lists"), *tokens, total)
