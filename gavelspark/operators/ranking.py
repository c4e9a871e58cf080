"""Ranking quality of pairwise verdicts.

Verdicts are (list_id, i, j, winner); preferences (list_id, winner, loser) with set semantics; candidates
(list_id, pos, pass_rate, n). Lists without any valid verdict are in no result. Joins are by list and position, so
a list with many deliveries of a verdict weighs no more than its distinct preferences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preference_set(verdicts: DataFrame) -> DataFrame:
    """Distinct (list_id, winner, loser) of verdicts with a winner among the two."""
    valid = verdicts.where("winner is not null and (winner = i or winner = j) and i <> j")
    return valid.select("list_id", "winner", F.when(F.col("winner") == F.col("i"), F.col("j")).otherwise(F.col("i")).alias("loser")).distinct()


def self_join_pairs(candidates: DataFrame) -> DataFrame:
    """All (i, j), i < j, of each list, built inside the row of the list: no shuffle beyond the list's own."""
    n = candidates.select("list_id", "n").distinct()
    return pairs_of(n)


def pairs_of(sizes: DataFrame) -> DataFrame:
    """All (i, j), i < j < n, of (list_id, n), in place."""
    row = sizes.where("n >= 2").select("list_id", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("i"), "n")
    return row.select("list_id", "i", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j"))


def triple_join(preferences: DataFrame) -> DataFrame:
    """(list_id, a, b, c, transitive) of every a < b < c whose three pairs are decided.

    Of contradicting preferences of a pair the one for the lower position counts.
    """
    x, y = F.least("winner", "loser"), F.greatest("winner", "loser")
    edge = preferences.groupBy("list_id", x.alias("x"), y.alias("y")).agg(F.max(F.col("winner") < F.col("loser")).alias("low"))
    ab = edge.select("list_id", F.col("x").alias("a"), F.col("y").alias("b"), F.col("low").alias("ab"))
    bc = edge.select("list_id", F.col("x").alias("b"), F.col("y").alias("c"), F.col("low").alias("bc"))
    ac = edge.select("list_id", F.col("x").alias("a"), F.col("y").alias("c"), F.col("low").alias("ac"))
    cycle = (F.col("ab") & F.col("bc") & ~F.col("ac")) | (~F.col("ab") & ~F.col("bc") & F.col("ac"))
    return ab.join(bc, ["list_id", "b"]).join(ac, ["list_id", "a", "c"]).select("list_id", "a", "b", "c", (~cycle).alias("transitive"))


def transitivity_per_list(preferences: DataFrame, sizes: DataFrame) -> DataFrame:
    """(list_id, n, triples, transitive) of lists with three candidates or more; lists without a decided triple stay, an unknown size is 0."""
    lists = preferences.select("list_id").distinct().join(sizes, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("n")).where("n >= 3")
    known = triple_join(preferences).join(sizes.where("n >= 3"), "list_id").where("c < n")
    counts = known.groupBy("list_id").agg(F.count("*").alias("triples"), F.count_if("transitive").alias("transitive"))
    return lists.join(counts, "list_id", "left").select("list_id", "n", F.coalesce("triples", F.lit(0)).alias("triples"), F.coalesce("transitive", F.lit(0)).alias("transitive"))


def transitivity(preferences: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: decided triples, transitive ones, and their share over all lists (0 without any)."""
    t = transitivity_per_list(preferences, sizes)
    return t.agg(F.coalesce(F.sum("triples"), F.lit(0)).alias("triples"), F.coalesce(F.sum("transitive"), F.lit(0)).alias("transitive")).withColumn("rate", F.round(F.coalesce(F.try_divide("transitive", "triples"), F.lit(0.0)), 9))


def win_counts(preferences: DataFrame, candidates: DataFrame) -> DataFrame:
    """(list_id, pos, pass_rate, n, wins), zeros included, of lists that have a preference."""
    wins = preferences.groupBy("list_id", F.col("winner").alias("pos")).agg(F.count("*").alias("wins"))
    lists = preferences.select("list_id").distinct()
    return candidates.join(lists, "list_id", "left_semi").join(wins, ["list_id", "pos"], "left").select("list_id", "pos", "pass_rate", "n", F.coalesce("wins", F.lit(0)).alias("wins"))


def ndcg_per_list(preferences: DataFrame, candidates: DataFrame) -> DataFrame:
    """(list_id, n, ndcg): order by wins, ties by position, against order by pass rate; lists without any gain are left out."""
    rated = win_counts(preferences, candidates.where("pass_rate is not null"))
    w = Window.partitionBy("list_id")
    gain = F.pow(F.lit(2.0), F.col("pass_rate")) - 1
    at = lambda order: F.log2(F.row_number().over(w.orderBy(*order)) + 1.0)
    terms = rated.select("list_id", "n", (gain / at([F.col("wins").desc(), F.col("pos")])).alias("dcg"), (gain / at([F.col("pass_rate").desc(), F.col("pos")])).alias("ideal"))
    sums = terms.groupBy("list_id", "n").agg(F.sum("dcg").alias("dcg"), F.sum("ideal").alias("ideal")).where("ideal <> 0")
    return sums.select("list_id", "n", F.round(F.col("dcg") / F.col("ideal"), 9).alias("ndcg"))


def ndcg(preferences: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: scored lists and their mean NDCG (0 without any)."""
    return ndcg_per_list(preferences, candidates).agg(F.count("*").alias("lists"), F.round(F.coalesce(F.avg("ndcg"), F.lit(0.0)), 6).alias("ndcg"))


def tau_per_list(preferences: DataFrame, candidates: DataFrame) -> DataFrame:
    """(list_id, n, tau): Kendall's tau-b of wins and pass rates; -1 where it is undefined (one candidate, or all tied in either)."""
    rated = win_counts(preferences, candidates.where("pass_rate is not null"))
    items = F.array_sort(F.collect_list(F.struct("pos", "wins", "pass_rate")))
    lists = rated.groupBy("list_id", "n").agg(items.alias("c"))
    sign = lambda x, y: F.signum((x - y).cast("double"))

    def pair(x, i):
        later = F.slice(F.col("c"), i + 2, F.size("c"))
        return F.transform(later, lambda y: F.struct(sign(x["wins"], y["wins"]).alias("s"), sign(x["pass_rate"], y["pass_rate"]).alias("r")))

    pairs = F.flatten(F.transform("c", pair))
    total = lambda f: F.aggregate(F.col("p"), F.lit(0.0), lambda acc, p: acc + f(p))
    p = lists.select("list_id", "n", pairs.alias("p"))
    both, one, two = total(lambda p: p["s"] * p["r"]), total(lambda p: F.abs(p["s"])), total(lambda p: F.abs(p["r"]))
    return p.select("list_id", "n", F.round(F.coalesce(F.try_divide(both, F.sqrt(one * two)), F.lit(-1.0)), 9).alias("tau"))


def kendall_tau_b(preferences: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: lists and mean tau-b, undefined ones counting as -1."""
    return tau_per_list(preferences, candidates).agg(F.count("*").alias("lists"), F.round(F.coalesce(F.avg("tau"), F.lit(0.0)), 6).alias("tau"))


def pairwise_accuracy(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: decided verdicts on pairs with different pass rates, and the share that agrees (0 without any)."""
    valid = verdicts.where("winner is not null and (winner = i or winner = j)").groupBy("list_id", "i", "j", "winner").agg(F.count("*").alias("votes"))
    rate = lambda x: candidates.select("list_id", F.col("pos").alias(x), F.col("pass_rate").alias(f"r{x}"))
    joined = valid.join(rate("i"), ["list_id", "i"]).join(rate("j"), ["list_id", "j"]).where("ri <> rj")
    right = (F.col("ri") > F.col("rj")) == (F.col("winner") == F.col("i"))
    sums = joined.agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("compared"), F.sum(F.when(right, F.col("votes")).otherwise(0)).alias("right"))
    return sums.select("compared", F.round(F.coalesce(F.try_divide("right", "compared"), F.lit(0.0)), 9).alias("accuracy"))
