"""Votes of several completions per list. Completions are (list_id, k, answer) with unique (list_id, k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions import text as X


def majority(answers: DataFrame) -> DataFrame:
    """(list_id, answer, k_total): the most frequent answer, null counting as one; of equal counts the one seen first."""
    counted = answers.groupBy("list_id", "answer").agg(F.count("*").alias("votes"), F.min("k").alias("first"))
    best = F.min(F.struct((-F.col("votes")).alias("votes"), "first", "answer")).alias("best")
    return counted.groupBy("list_id").agg(best, F.sum("votes").alias("k_total")).select("list_id", "best.answer", "k_total")


def sc_accuracy(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of lists whose majority answer is the truth (list_id, chosen_answer)."""
    joined = majority(answers).join(truth, "list_id")
    return joined.agg(F.count("*").alias("lists"), F.round(F.avg(F.col("answer").eqNullSafe(F.col("chosen_answer")).cast("double")), 9).alias("sc"))


def bon_accuracy(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of lists with the truth among several answers; lists with one answer have no value."""
    hit = F.max(F.col("answer").eqNullSafe(F.col("chosen_answer")).cast("int"))
    per_list = answers.join(truth, "list_id").groupBy("list_id").agg(F.when(F.count("*") > 1, hit).alias("hit"))
    return per_list.agg(F.count("hit").alias("lists"), F.round(F.avg("hit"), 9).alias("bon"))


def vote_distribution(answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of votes per valid option (0 where none), prediction (most votes, then alphabetical), confidence.

    ``sizes`` is (list_id, n). Answers are stripped and upper-cased; others than the first n letters are no votes;
    lists without a vote have null prediction and confidence.
    """
    said = F.upper(X.strip(F.col("answer")))
    votes = sizes.join(answers.select("list_id", said.alias("opt")), "list_id", "left")
    valid = F.regexp_like("opt", F.lit("^[A-H]$")) & (F.ascii("opt") - 65 < F.col("n"))
    per_option = votes.groupBy("list_id", "n", F.when(valid, F.col("opt")).alias("opt")).agg(F.count("*").alias("votes"))
    entries = F.collect_list(F.when(F.col("opt").isNotNull(), F.struct((-F.col("votes")).alias("less"), "opt")))
    per_list = per_option.groupBy("list_id", "n").agg(F.array_sort(entries).alias("e"))
    total = F.aggregate("e", F.lit(0).cast("long"), lambda acc, x: acc - x["less"])
    counted = F.map_from_entries(F.transform("e", lambda x: F.struct(x["opt"], -x["less"])))
    options = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)))
    dist = F.map_from_arrays(options, F.transform(options, lambda o: F.coalesce(F.try_element_at(counted, o), F.lit(0)) / total))
    top = F.get("e", F.lit(0))
    some = F.size("e") > 0
    return per_list.select("list_id", total.alias("n_votes"), F.when(some, dist).alias("dist"), top["opt"].alias("predicted"), F.when(some, F.round(-top["less"] / total, 9)).alias("conf"))


def option_softmax(position_logprobs: DataFrame, option_tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """(list_id, opt, p): softmax over the best log probability of each valid option.

    A missing option takes the least finite one less 20; a list in which all are missing has null throughout.
    """
    options = sizes.select("list_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("list_id", F.substring(F.lit("ABCDEFGH"), F.col("i") + 1, F.lit(1)).alias("opt"))
    best = position_logprobs.join(option_tokens, "token_id").groupBy("list_id", "opt").agg(F.max("logprob").alias("lp"))
    w = Window.partitionBy("list_id")
    raw = options.join(best, ["list_id", "opt"], "left").withColumn("lp", F.coalesce("lp", F.min("lp").over(w) - 20.0))
    e = raw.withColumn("e", F.exp(F.col("lp") - F.max("lp").over(w)))
    return e.select("list_id", "opt", F.round(F.col("e") / F.sum("e").over(w), 9).alias("p"))


def argmax_option(distribution: DataFrame, truth: DataFrame) -> DataFrame:
    """Most probable option (ties: first letter), its probability, and whether it is the truth; lists without one are left out."""
    best = distribution.where("p is not null").groupBy("list_id").agg(F.min(F.struct((-F.col("p")).alias("less"), "opt")).alias("b"))
    joined = best.join(truth, "list_id")
    return joined.select("list_id", F.col("b.opt").alias("predicted"), (-F.col("b.less")).alias("conf"), (F.col("b.opt") == F.col("chosen_answer")).cast("int").alias("is_correct"))


def verdict_coverage(parsed: Column) -> list[Column]:
    """Aggregates: all rows, and rows with a verdict."""
    return [F.count("*").alias("total"), F.count(parsed).alias("parsed")]


def box_token_index(tokens: DataFrame, box: str = r"\boxed{") -> DataFrame:
    """(list_id, box_token): position of the first token that reaches beyond the first box opener, from (list_id, token_pos, piece).

    The text of a list is put together once for the search; a list without opener, or that ends with it, is left out.
    """
    w = Window.partitionBy("list_id").orderBy("token_pos")
    ends = tokens.withColumn("reached", F.sum(F.length("piece")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "piece"))), lambda t: t["piece"]), "")
    goal = tokens.groupBy("list_id").agg(text.alias("text")).select("list_id", F.instr("text", box).alias("at")).where("at > 0")
    beyond = ends.join(goal, "list_id").where(F.col("reached") > F.col("at") - 1 + len(box))
    return beyond.groupBy("list_id").agg(F.min("token_pos").alias("box_token"))
