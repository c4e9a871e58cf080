"""Inputs of the operators, derived from the tables by rule: the same rows in Spark (``Frames``) and DuckDB (``PRELUDE``)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelspark.sources.readers import scan_table

SAMPLES = 8

#: One text of both dialects: a completion of a list, well formed or not.
_TEXT = """CASE
  WHEN h = 0 THEN concat('<think>', chr(10), 'x', chr(10), '</think> no verdict')
  WHEN h = 1 THEN concat('<think>x</think>', chr(92), 'boxed{Z}')
  WHEN h = 2 THEN concat('<think>x', chr(92), 'boxed{', truth, '}')
  WHEN h = 3 THEN concat('<think>x</think>', chr(92), 'boxed{', chr(9), lower(truth), ' }')
  WHEN h = 4 THEN concat('<think>a<think>b</think>', chr(92), 'boxed{', truth, '}')
  WHEN h = 5 THEN concat('<think>x</think>', chr(92), 'boxed{[[', truth, ']]}')
  WHEN h = 6 THEN CAST(NULL AS VARCHAR(9))
  WHEN h < 13 THEN concat('<think>x</think>', chr(10), chr(92), 'boxed{', truth, '}')
  ELSE concat('<think>x</think>', chr(92), 'boxed{', chr(CAST(65 + (coalesce(chosen_position, 0) + h) % n AS INT)), '}') END"""
_SCORE_TEXT = """CASE
  WHEN h = 0 THEN concat('<think>x</think>', chr(92), 'boxed{[', '7', ']}')
  WHEN h = 1 THEN concat('<think>x</think>', chr(92), 'boxed{nope}')
  WHEN h = 2 THEN concat('<think>x</think> ', chr(92), 'boxed{[11, ', digits, ']}')
  WHEN h = 3 THEN concat('<think>x<think></think>', chr(92), 'boxed{[', digits, ']}')
  WHEN h = 4 THEN concat('<think>x</think>', chr(92), 'boxed{[', digits, ',]}')
  WHEN h = 5 THEN concat('<think>x</think>', chr(92), 'boxed{[', digits, ', 3.5]}')
  ELSE concat('<think>x</think>', chr(10), chr(92), 'boxed{[', digits, ']}') END"""
_STDOUT = """CASE WHEN good AND tc_id = 1 THEN concat('v', CAST(tc_id AS VARCHAR(9)), '  ', chr(10)) WHEN good AND tc_id = 2 THEN '{"b": 2, "a": 1}' WHEN good AND tc_id = 3 THEN '1e2' WHEN tc_id = 2 THEN '{"a": 1, "b": 3}' WHEN good THEN concat('v', CAST(tc_id AS VARCHAR(9))) ELSE 'wrong' END"""
_EXPECTED = """CASE WHEN tc_id = 2 THEN '{"a":1,"b":2}' WHEN tc_id = 3 THEN '100' ELSE concat('v', CAST(tc_id AS VARCHAR(9))) END"""

#: Outputs are equal as text, as numbers, or as JSON objects with whole numbers.
SAME = """(rtrim(stdout, ' ' || chr(10)) = expected OR coalesce(TRY_CAST(stdout AS DOUBLE) = TRY_CAST(expected AS DOUBLE), false)
  OR (starts_with(stdout, '{') AND starts_with(expected, '{') AND list_sort(map_entries(CAST(CAST(CASE WHEN starts_with(stdout, '{') THEN stdout ELSE '{}' END AS JSON) AS MAP(VARCHAR, BIGINT)))) = list_sort(map_entries(CAST(CAST(CASE WHEN starts_with(expected, '{') THEN expected ELSE '{}' END AS JSON) AS MAP(VARCHAR, BIGINT))))))"""

PRELUDE = f"""WITH lists AS (
  SELECT list_id, split, source, domain, query, language, candidates, num_candidates AS n, chosen_answer, chosen_position, pass_rates
  FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY ingested_at, split) AS rn FROM evaluate WHERE list_id IS NOT NULL) z WHERE rn = 1),
ks AS (SELECT CAST(unnest(range(0, {SAMPLES})) AS INT) AS k),
cand AS (SELECT l.list_id, k.k AS pos, l.candidates[k.k + 1] AS code, l.pass_rates[k.k + 1] AS pass_rate, l.n FROM lists l JOIN ks k ON k.k < l.n),
samp AS (SELECT list_id, n, chosen_position, chosen_answer, coalesce(chosen_answer, 'A') AS truth, pass_rates, k, CAST((list_id*17 + k*29 + n*5) % 20 AS INT) AS h FROM lists CROSS JOIN ks),
comp AS (SELECT list_id, k, n, chosen_position, chosen_answer, pass_rates, {_TEXT} AS text FROM samp),
digits AS (SELECT c.list_id, k.k, string_agg(CAST((CAST(floor(coalesce(c.pass_rate, 0)*10) AS INT) + (c.list_id + k.k + c.pos) % 3) % 12 AS VARCHAR), ', ' ORDER BY c.pos) AS digits FROM cand c CROSS JOIN (SELECT k FROM ks WHERE k < 4) k GROUP BY c.list_id, k.k),
scores AS (SELECT list_id, k, n, chosen_position, pass_rates, {_SCORE_TEXT} AS text FROM (SELECT l.list_id, d.k, l.n, l.chosen_position, l.pass_rates, d.digits, CAST((l.list_id*7 + d.k*3) % 17 AS INT) AS h FROM lists l JOIN digits d ON l.list_id = d.list_id) z),
verdicts AS (SELECT list_id, i, j, CASE WHEN winner = i OR winner = j THEN winner END AS winner FROM (SELECT *, row_number() OVER (PARTITION BY list_id, i, j ORDER BY record_id, received_at) AS rn FROM ranking_consistency WHERE list_id IS NOT NULL AND i < j) z WHERE rn = 1),
prefs AS (SELECT DISTINCT list_id, winner, CASE WHEN winner = i THEN j ELSE i END AS loser FROM verdicts WHERE winner IS NOT NULL),
wins AS (SELECT c.list_id, c.pos, c.pass_rate, c.n, coalesce(w.wins, 0) AS wins FROM cand c LEFT JOIN (SELECT list_id, winner AS pos, count(*) AS wins FROM prefs GROUP BY ALL) w ON c.list_id = w.list_id AND c.pos = w.pos WHERE c.list_id IN (SELECT list_id FROM prefs)),
executions AS (SELECT prob_id, cand, tc_id, {_STDOUT} AS stdout, {_EXPECTED} AS expected, CAST(CASE WHEN NOT good AND (prob_id + tc_id) % 7 = 0 THEN 1 ELSE 0 END AS INT) AS rc FROM (SELECT list_id AS prob_id, pos AS cand, k AS tc_id, k < coalesce(pass_rate, 0)*4 AS good FROM cand CROSS JOIN (SELECT k FROM ks WHERE k < 4) t) z),
counts AS (SELECT prob_id, cand, count(*) FILTER (rc = 0 AND {SAME}) AS passed, count(*) AS total FROM executions GROUP BY ALL),
answers AS (SELECT list_id, k, n, chosen_answer, CASE WHEN regexp_matches(text, '\\\\boxed\\{{(.*?)\\}}') THEN CASE WHEN contains(regexp_extract(text, '\\\\boxed\\{{(.*?)\\}}', 1), '[[') THEN regexp_extract(text, '\\[\\[(.*?)\\]\\]', 1) ELSE regexp_extract(text, '\\\\boxed\\{{(.*?)\\}}', 1) END END AS answer FROM comp),
logprobs AS (SELECT l.list_id, o.token_id, -CAST((l.list_id*7 + o.token_id*13) % 50 AS DOUBLE) / CAST(7 AS DOUBLE) AS logprob, o.opt FROM lists l CROSS JOIN (SELECT k*10 + s AS token_id, chr(CAST(65 + k AS INT)) AS opt FROM ks CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 AS s) s) o WHERE (l.list_id + o.token_id) % 5 <> 0),
softmax AS (SELECT list_id, opt, round(e / sum(e) OVER (PARTITION BY list_id), 9) AS p FROM (SELECT list_id, opt, exp(lp - max(lp) OVER (PARTITION BY list_id)) AS e FROM (SELECT o.list_id, o.opt, coalesce(max(p.logprob), min(max(p.logprob)) OVER (PARTITION BY o.list_id) - 20) AS lp FROM (SELECT list_id, chr(CAST(65 + pos AS INT)) AS opt FROM cand) o LEFT JOIN logprobs p ON p.list_id = o.list_id AND p.opt = o.opt GROUP BY o.list_id, o.opt) r) e),
said AS (SELECT list_id, n, upper(trim(answer, ' ' || chr(9) || chr(10) || chr(13))) AS opt FROM answers),
votes AS (SELECT list_id, opt, count(*) AS votes FROM said WHERE length(opt) = 1 AND opt >= 'A' AND ascii(opt) - 65 < n GROUP BY ALL),
voted AS (SELECT list_id, CAST(sum(votes) AS BIGINT) AS n_votes, arg_min(opt, (-votes, opt)) AS predicted, round(CAST(max(votes) AS DOUBLE) / sum(votes), 9) AS conf FROM votes GROUP BY list_id),
records AS (SELECT l.list_id, v.n_votes, v.predicted, v.conf, CAST(CASE WHEN v.conf IS NOT NULL THEN coalesce(CAST(v.predicted = l.chosen_answer AS INT), 0) END AS INT) AS is_correct FROM lists l LEFT JOIN voted v ON l.list_id = v.list_id),
summary AS (SELECT source AS eval_llm, lang AS data, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)
"""


class Frames:
    """The derived inputs as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return scan_table(self.spark, self.sf_dir, name)

    @cached_property
    def lists(self) -> DataFrame:
        w = Window.partitionBy("list_id").orderBy("ingested_at", "split")
        first = self.table("evaluate").where("list_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
        return first.select("list_id", "split", "source", "domain", "query", "language", "candidates", F.col("num_candidates").alias("n"), "chosen_answer", "chosen_position", "pass_rates")

    @cached_property
    def sizes(self) -> DataFrame:
        return self.lists.select("list_id", "n")

    @cached_property
    def truth(self) -> DataFrame:
        return self.lists.select("list_id", "chosen_answer")

    @cached_property
    def cand(self) -> DataFrame:
        row = self.lists.select("list_id", "n", "candidates", "pass_rates", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
        return row.select("list_id", "pos", F.get("candidates", "pos").alias("code"), F.get("pass_rates", "pos").alias("pass_rate"), "n")

    @cached_property
    def comp(self) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("k")
        row = self.lists.select("list_id", "n", "chosen_position", "chosen_answer", F.coalesce("chosen_answer", F.lit("A")).alias("truth"), "pass_rates", k)
        row = row.withColumn("h", F.expr("CAST((list_id*17 + k*29 + n*5) % 20 AS INT)"))
        return row.select("list_id", "k", "n", "chosen_position", "chosen_answer", "pass_rates", F.expr(_TEXT).alias("text"))

    @cached_property
    def answers(self) -> DataFrame:
        from gavelspark.functions.text import boxed_text_eval

        return self.comp.select("list_id", "k", "n", "chosen_answer", boxed_text_eval(F.col("text")).alias("answer"))

    @cached_property
    def scores(self) -> DataFrame:
        row = self.lists.select("list_id", "n", "chosen_position", "pass_rates", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        digit = lambda p: ((F.floor(F.coalesce(F.get("pass_rates", p), F.lit(0.0)) * 10).cast("int") + (F.col("list_id") + F.col("k") + p) % 3) % 12).cast("string")
        row = row.withColumn("digits", F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), digit), ", ")).withColumn("h", F.expr("CAST((list_id*7 + k*3) % 17 AS INT)"))
        return row.select("list_id", "k", "n", "chosen_position", "pass_rates", F.expr(_SCORE_TEXT).alias("text"))

    @cached_property
    def verdicts(self) -> DataFrame:
        raw = self.table("ranking_consistency").where("list_id is not null and i < j")
        # buffers of fixed width, so the aggregation hashes and combines before the shuffle
        first = raw.groupBy("list_id", "i", "j").agg(F.min_by("winner", "record_id").alias("w"))
        return first.select("list_id", "i", "j", F.when((F.col("w") == F.col("i")) | (F.col("w") == F.col("j")), F.col("w")).alias("winner"))

    @cached_property
    def prefs(self) -> DataFrame:
        from gavelspark.operators.ranking import preference_set

        return preference_set(self.verdicts)

    @cached_property
    def executions(self) -> DataFrame:
        row = self.cand.select(F.col("list_id").alias("prob_id"), F.col("pos").alias("cand"), "pass_rate", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tc_id"))
        row = row.withColumn("good", F.col("tc_id") < F.coalesce("pass_rate", F.lit(0.0)) * 4)
        rc = F.expr("CAST(CASE WHEN NOT good AND (prob_id + tc_id) % 7 = 0 THEN 1 ELSE 0 END AS INT)")
        return row.select("prob_id", "cand", "tc_id", F.expr(_STDOUT).alias("stdout"), F.expr(_EXPECTED).alias("expected"), rc.alias("rc"))

    @cached_property
    def counts(self) -> DataFrame:
        from gavelspark.operators.selection import test_pass_count

        return test_pass_count(self.executions)

    @cached_property
    def option_tokens(self) -> DataFrame:
        return self.spark.range(16).select((F.floor(F.col("id") / 2) * 10 + F.col("id") % 2).cast("int").alias("token_id"), F.substring(F.lit("ABCDEFGH"), F.floor(F.col("id") / 2).cast("int") + 1, F.lit(1)).alias("opt"))

    @cached_property
    def logprobs(self) -> DataFrame:
        ids = F.array(*[F.lit(k * 10 + s) for k in range(8) for s in (0, 1)])
        row = self.lists.select("list_id", F.explode(ids).alias("token_id"))
        return row.where("(list_id + token_id) % 5 <> 0").select("list_id", "token_id", (-((F.col("list_id") * 7 + F.col("token_id") * 13) % 50).cast("double") / 7.0).alias("logprob"))

    @cached_property
    def tokens(self) -> DataFrame:
        """Completions 0 in pieces of three characters."""
        text = self.comp.where("k = 0 and text is not null")
        at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3).cast("int"))).alias("token_pos")
        return text.select("list_id", "text", at).select("list_id", "token_pos", F.substring("text", F.col("token_pos") * 3 + 1, F.lit(3)).alias("piece"))

    @cached_property
    def records(self) -> DataFrame:
        from gavelspark.operators.votes import vote_distribution

        votes = vote_distribution(self.answers.select("list_id", "answer"), self.sizes)
        right = F.when(F.col("conf").isNotNull(), F.coalesce((F.col("predicted") == F.col("chosen_answer")).cast("int"), F.lit(0)))
        return votes.join(self.truth, "list_id").select("list_id", F.when(F.col("conf").isNotNull(), F.col("n_votes")).alias("n_votes"), "predicted", "conf", right.alias("is_correct"))

    @cached_property
    def summary(self) -> DataFrame:
        docs = self.table("documents").where("source is not null and lang is not null")
        return docs.groupBy(F.col("source").alias("eval_llm"), F.col("lang").alias("data")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
