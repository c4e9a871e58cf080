"""Outcome of choosing one candidate program per problem, from test executions (prob_id, cand, tc_id, stdout, expected, rc)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import text as X


def test_pass_count(executions: DataFrame) -> DataFrame:
    """(prob_id, cand, passed, total): a test is passed if it returned 0 and its output matches."""
    passed = (F.col("rc") == 0) & X.outputs_match(F.col("stdout"), F.col("expected"))
    return executions.groupBy("prob_id", "cand").agg(F.count_if(passed).alias("passed"), F.count("*").alias("total"))


def pair_winners(answers: DataFrame, scoring: bool = False) -> DataFrame:
    """(prob_id, i, j, winner) of answers (prob_id, i, j, swapped, text): the verdict A or B in a text means i or j, and j or i
    where the two were shown in swapped order. A null ``swapped`` is the plain order; a text without verdict has a null winner."""
    verdict = X.pair_verdict(F.col("text"), scoring)
    first = (verdict == "A") != F.coalesce("swapped", F.lit(False))
    return answers.select("prob_id", "i", "j", F.when(verdict.isNotNull(), F.when(first, F.col("i")).otherwise(F.col("j"))).alias("winner"))


def select_pairwise(verdicts: DataFrame, problems: DataFrame) -> DataFrame:
    """(prob_id, sel): most wins over verdicts (prob_id, i, j, winner), ties to the lowest index, null without a win.

    With both orders of each pair (``pair_winners``), each order is a verdict of its own."""
    wins = verdicts.where("winner is not null").groupBy("prob_id", "winner").agg(F.count("*").alias("wins"))
    best = wins.groupBy("prob_id").agg(F.min(F.struct((-F.col("wins")).alias("less"), "winner"))["winner"].alias("sel"))
    return problems.select("prob_id").distinct().join(best, "prob_id", "left")


def select_list(verdicts: DataFrame, scoring: bool = False) -> DataFrame:
    """(prob_id, sel) from one list verdict (prob_id, text, n) per problem."""
    return verdicts.select("prob_id", X.list_verdict(F.col("text"), F.col("n"), scoring).alias("sel"))


def pass_at_1(selections: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: problems, and the share whose selection passes all tests.

    A null selection fails and still counts; an index beyond the candidates means the last one; problems without
    tests do not count.
    """
    last = counts.groupBy("prob_id").agg(F.max("cand").alias("last"))
    chosen = selections.join(last, "prob_id").withColumn("cand", F.least("sel", "last"))
    joined = chosen.join(counts, ["prob_id", "cand"], "left")
    good = F.coalesce((F.col("passed") == F.col("total")) & F.col("sel").isNotNull(), F.lit(False))
    return joined.agg(F.count("*").alias("problems"), F.round(F.coalesce(F.avg(good.cast("double")), F.lit(0.0)), 9).alias("pass_at_1"))


def oracle_pass(counts: DataFrame) -> DataFrame:
    """One row: share of problems with any candidate that passes all its tests."""
    per = counts.groupBy("prob_id").agg(F.bool_or(F.col("passed") == F.col("total")).alias("good"))
    return per.agg(F.count("*").alias("problems"), F.round(F.coalesce(F.avg(F.col("good").cast("double")), F.lit(0.0)), 9).alias("oracle"))


def random_pass(counts: DataFrame, seed: int = 0) -> DataFrame:
    """One row: share of problems whose candidate picked by a hash of the problem passes; the pick is the same in every run."""
    picked = F.pmod(F.col("prob_id") * 31 + seed, F.col("n"))
    per = counts.join(counts.groupBy("prob_id").agg(F.count("*").alias("n")), "prob_id").where(F.col("cand") == picked)
    return per.agg(F.count("*").alias("problems"), F.round(F.coalesce(F.avg((F.col("passed") == F.col("total")).cast("double")), F.lit(0.0)), 9).alias("random"))


def execute_code(jobs: DataFrame, timeout: float = 10.0, allow: bool = False) -> DataFrame:
    """Run (prob_id, cand, tc_id, code, stdin) in a Python process each; (prob_id, cand, tc_id, stdout, rc).

    This runs code from the data with the rights of the executor, so it must be allowed explicitly. A timeout gives
    ("TIMEOUT", -1), any other failure to run ("ERROR: ...", -1).
    """
    if not allow:
        raise PermissionError("execute_code runs untrusted programs; pass allow=True to do so")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess
        import sys
        import tempfile

        for f in frames:
            rows = []
            for code, given in zip(f.code, f.stdin):
                try:
                    with tempfile.NamedTemporaryFile("w", suffix=".py") as source:
                        source.write(code or "")
                        source.flush()
                        done = subprocess.run([sys.executable, source.name], input=given or "", capture_output=True, text=True, timeout=timeout)
                    rows.append((done.stdout, done.returncode))
                except subprocess.TimeoutExpired:
                    rows.append(("TIMEOUT", -1))
                except Exception as e:
                    rows.append((f"ERROR: {e}", -1))
            yield f[["prob_id", "cand", "tc_id"]].assign(stdout=[r[0] for r in rows], rc=[r[1] for r in rows])

    ids = ", ".join(f"{c} {jobs.schema[c].dataType.simpleString()}" for c in ("prob_id", "cand", "tc_id"))
    return jobs.select("prob_id", "cand", "tc_id", "code", "stdin").mapInPandas(run, f"{ids}, stdout string, rc int")
