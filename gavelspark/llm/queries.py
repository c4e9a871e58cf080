"""The pN_ queries: each problem's operator over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm import near_duplicates as nd
from gavelspark.llm.bpe import CountLattice
from gavelspark.llm.encoding import encode_texts
from gavelspark.llm.leaks import leak_report, leaked_items
from gavelspark.llm.pair_defects import pair_defects
from gavelspark.llm.pair_ranking import policy_games, ranking, strengths
from gavelspark.llm.personal import found_pieces, redacted
from gavelspark.llm.split_overlap import coverage_report, overlap_report, split_overlaps
from gavelspark.llm.token_budget import token_budget
from gavelspark.session import materialize, ship_package, spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(_read(spark, sf_dir, name))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary; the folder is a parameter."""
    return os.path.join(os.environ.get("GAVEL_TOKENIZERS", "/opt/tokenizers"), name)


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "evaluate").select("list_id", F.posexplode("candidates").alias("pos", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-same programs."""
    links, members = nd.near_duplicates(_programs(spark, sf_dir), ["list_id", "pos"], "text")
    return nd.flat(nd.expand(links, members), ["list_id", "pos"], ["list", "pos"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lists that occur in train and outside."""
    found = split_overlaps(_spread(spark, sf_dir, "evaluate"), _read(spark, sf_dir, "language_names"))
    return found.select(F.least("train_id", "other_id").alias("list_a"), F.greatest("train_id", "other_id").alias("list_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with train per split and source."""
    lists = _spread(spark, sf_dir, "evaluate")
    return overlap_report(split_overlaps(lists, _read(spark, sf_dir, "language_names")), lists)


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists outside train that overlap with train, with what is covered of each."""
    lists = _spread(spark, sf_dir, "evaluate")
    return coverage_report(split_overlaps(lists, _read(spark, sf_dir, "language_names")), lists)


def _ranking(spark: SparkSession, sf_dir: str, link: str, errors: bool = True) -> DataFrame:
    games = policy_games(_read(spark, sf_dir, "ranking_consistency"), _read(spark, sf_dir, "candidate_policies"))
    return ranking(strengths(games, link, errors=errors), _read(spark, sf_dir, "policies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all policies by their probit strengths."""
    return _ranking(spark, sf_dir, "probit", errors=False).select("place", "policy")


def p2_probit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probit strengths with standard errors."""
    return _ranking(spark, sf_dir, "probit")


def p2_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the logit link, by which the chance of a win is s_x / (s_x + s_y)."""
    return _ranking(spark, sf_dir, "logit")


def p2_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and losses of each pair of policies: what the fit sees."""
    return policy_games(_read(spark, sf_dir, "ranking_consistency"), _read(spark, sf_dir, "candidate_policies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective sides of preference pairs."""
    labelled = _read(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "text")
    return pair_defects(_spread(spark, sf_dir, "thinkdpo_training"), labelled)


def p4_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of byte_bpe_50k per source, language and domain."""
    return token_budget(_spread(spark, sf_dir, "evaluate"), _read(spark, sf_dir, "language_names"), CountLattice.of_merges(vocabulary()))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every program with its class of equal programs, its group of near-same ones and its number of links."""
    links, members = nd.near_duplicates(_programs(spark, sf_dir), ["list_id", "pos"], "text")
    g = nd.groups(links, members)
    return g.select("id.list_id", "id.pos", F.col("rep.list_id").alias("class_list"), F.col("rep.pos").alias("class_pos"), F.col("root.list_id").alias("group_list"), F.col("root.pos").alias("group_pos"), "links")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under byte_bpe_50k."""
    return encode_texts(_spread(spark, sf_dir, "documents"), "doc_id", "text", vocabulary())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of a held-out item."""
    return leaked_items(_spread(spark, sf_dir, "documents"), _read(spark, sf_dir, "heldout_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the documents and sources that hold them."""
    return leak_report(p7_found(spark, sf_dir), _read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different piece of personal information of each document."""
    return found_pieces(_spread(spark, sf_dir, "documents"), _read(spark, sf_dir, "given_names")).select("doc_id", "kind", "found").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with typed placeholders in place of personal information."""
    names = _read(spark, sf_dir, "given_names")
    found = materialize(found_pieces(_spread(spark, sf_dir, "documents"), names), "found")
    return redacted(_read(spark, sf_dir, "documents"), found, names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_report": p1_report, "p1_coverage": p1_coverage, "p2_found": p2_found, "p2_probit": p2_probit, "p2_logit": p2_logit, "p2_games": p2_games, "p3_found": p3_found, "p4_token_budget": p4_token_budget, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_redacted": p8_redacted}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in QUERIES.items()}
