"""Problem 2: one ranking from pairwise comparisons.

Strengths maximise the likelihood of all comparisons with a normal prior (ridge), by iteratively reweighted
least squares; the sparse normal equations of each round are solved by conjugate gradients, and the same
solver gives the standard errors. The link is a parameter: ``probit``, or ``logit``, under which the chance that x
beats y is s_x / (s_x + s_y) with s = exp(strength).

The comparisons are reduced to one row per pair of items before anything else. The pairs are a table that stays
distributed: each product with the normal matrix is one pass over it, with sums per item that are combined before they
move. Vectors have one number per item and are with the driver; up to ``MAX_SENT`` items they are broadcast to the pairs,
beyond it they are joined with them. The numbers are the same either way, and there is no other path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.session import materialize

#: Items up to which a vector is broadcast (8 bytes each).
MAX_SENT = 2_000_000
#: Pairs in a partition; the passes over few pairs are short.
PART_ROWS = 500_000
#: Precision of the prior of each strength, in comparisons' worth of information.
RIDGE = 0.01
#: Rounds after which a fit that has not converged is an error, and the largest step of a converged one.
ROUNDS, TOLERANCE = 100, 1e-8
#: Right-hand sides that are solved at once for the standard errors. With at most so many items the errors are exact; with
#: more they are estimated from so many random probes, with a standard deviation of about sqrt(1 / (2 PROBES)) of their size.
PROBES = 128


def _erf(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erf, x), np.float64, len(x))


def working(eta: np.ndarray, wins: np.ndarray, n: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray]:
    """Fisher weight and score of each pair at the difference of strengths ``eta``."""
    if link == "logit":
        p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        return n * p * (1 - p), wins - n * p
    if link != "probit":
        raise ValueError(f"unknown link {link}")
    eta = np.clip(eta, -6, 6)
    p = 0.5 * (1 + _erf(eta / math.sqrt(2)))
    density = np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
    ratio = density / (p * (1 - p))
    return n * density * ratio, (wins - n * p) * ratio


class Pairs:
    """The pairs (i, j, wins, losses) of numbered items: gradient, diagonal and products of the normal matrix, by one pass each."""

    def __init__(self, pairs: DataFrame, size: int, link: str, ridge: float, max_sent: int = MAX_SENT):
        self.pairs, self.size, self.link, self.ridge, self.max_sent = pairs, size, link, ridge, max_sent

    def _pass(self, beta: np.ndarray, vectors: np.ndarray, terms) -> np.ndarray:
        """Sums per item of terms(weight, score, difference of the vectors), whose rows add to i and its negatives, or, for the diagonal, itself, to j."""
        spark, link, columns = self.pairs.sparkSession, self.link, vectors.shape[1]
        schema = "column int, item int, value double"
        if self.size <= self.max_sent:
            sent, table = spark.sparkContext.broadcast((beta, vectors)), self.pairs
        else:
            lists = pa.ListArray.from_arrays(np.arange(self.size + 1, dtype=np.int32) * columns, vectors.ravel())
            held = spark.createDataFrame(pa.table({"item": pa.array(np.arange(self.size), pa.int32()), "b": beta, "v": lists}))
            ends = lambda x: held.select(F.col("item").alias(x), F.col("b").alias(f"b{x}"), F.col("v").alias(f"v{x}"))
            sent, table = None, self.pairs.join(ends("i"), "i").join(ends("j"), "j")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, j, wins, losses = (batch.column(c).to_numpy() for c in ("i", "j", "wins", "losses"))
                if sent is not None:
                    strength, v = sent.value
                    eta, moved = strength[i] - strength[j], v[i] - v[j]
                else:
                    eta = batch.column("bi").to_numpy() - batch.column("bj").to_numpy()
                    moved = np.subtract(*(batch.column(c).flatten().to_numpy().reshape(-1, columns) for c in ("vi", "vj")))
                weight, score = working(eta, wins.astype(np.float64), (wins + losses).astype(np.float64), link)
                at_i, at_j = terms(weight, score, moved)
                items, where = np.unique(np.concatenate((i, j)), return_inverse=True)
                sums = np.stack([np.bincount(where, x, len(items)) for x in np.concatenate((at_i, at_j)).T])
                out = [np.repeat(np.arange(len(sums)), len(items)), np.tile(items, len(sums)), sums.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.float64()))], ["column", "item", "value"])

        summed = table.mapInArrow(run, schema).groupBy("column", "item").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros((self.size, max(1, columns)))
        out[summed["item"].to_numpy(), summed["column"].to_numpy()] = summed["value"].to_numpy()
        if sent is not None:
            sent.unpersist()
        return out

    def start(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the penalised likelihood and diagonal of the normal matrix."""

        def terms(weight, score, _):
            return np.stack([score, weight], 1), np.stack([-score, weight], 1)

        found = self._pass(beta, np.zeros((self.size, 2)), terms)
        return found[:, 0] - self.ridge * beta, found[:, 1] + self.ridge

    def product(self, beta: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        def terms(weight, _, moved):
            return weight[:, None] * moved, -weight[:, None] * moved

        return self._pass(beta, vectors, terms) + self.ridge * vectors


def conjugate_gradients(product, rhs: np.ndarray, diagonal: np.ndarray, tolerance: float) -> np.ndarray:
    """Solve product(x) = rhs, column by column at once, for a positive definite product, preconditioned by its diagonal.

    An error if the residual of some column stays above ``tolerance`` times its right-hand side."""
    x, r = np.zeros_like(rhs), rhs.copy()
    z = r / diagonal[:, None]
    p, rz = z.copy(), (r * z).sum(axis=0)
    goal = np.maximum(tolerance * np.abs(rhs).max(axis=0, initial=0.0), 1e-300)
    for _ in range(10 * len(rhs) + 50):
        live = np.abs(r).max(axis=0, initial=0.0) > goal
        if not live.any():
            return x
        q = product(p)
        step = np.where(live, rz / np.where(live, (p * q).sum(axis=0), 1.0), 0.0)
        x += step * p
        r -= step * q
        z = r / diagonal[:, None]
        rz, before = (r * z).sum(axis=0), rz
        p = z + np.where(live, rz / np.where(before > 0, before, 1.0), 0.0) * p
    raise RuntimeError("conjugate gradients did not converge")


def fit(system, size: int, errors: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Strengths and (NaN without ``errors``) standard errors of the strengths less their mean; the mean itself is fixed by the prior only."""
    beta = np.zeros(size)
    for _ in range(ROUNDS):
        gradient, diagonal = system.start(beta)
        # the nearer the goal, the more exact the step
        exact = min(0.1, max(1e-3, float(np.abs(gradient / diagonal).max(initial=0.0))))
        step = conjugate_gradients(lambda v: system.product(beta, v), gradient[:, None], diagonal, exact)[:, 0]
        largest = float(np.abs(step).max(initial=0.0))
        beta = beta + step * min(1.0, 4.0 / max(1e-300, largest))
        if largest < TOLERANCE:
            break
    else:
        raise RuntimeError("the strengths did not converge")
    if not errors:
        return beta, np.full(size, np.nan)
    _, diagonal = system.start(beta)
    if size <= PROBES:
        units = np.eye(size) - 1.0 / max(1, size)
        return beta, np.sqrt(np.maximum(0.0, np.diagonal(conjugate_gradients(lambda v: system.product(beta, v), units, diagonal, 1e-6))))
    signs = np.random.default_rng(0).choice([-1.0, 1.0], (size, PROBES))
    solved = conjugate_gradients(lambda v: system.product(beta, v), signs - signs.mean(axis=0), diagonal, 1e-4)
    return beta, np.sqrt(np.maximum(0.0, (signs * solved).mean(axis=1)))


def strengths(pairs: DataFrame, link: str = "probit", ridge: float = RIDGE, errors: bool = True, max_sent: int = MAX_SENT) -> DataFrame:
    """(item, strength, std_error, comparisons) from pairs (x, y, wins of x, losses of x), one row per pair; std_error is NaN without ``errors``.

    Items are compared as strings. Without pairs there are no rows. A fit that does not converge is an error.
    """
    spark = pairs.sparkSession
    kept = materialize(pairs.select(F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "wins", "losses"), "games")
    games = lambda c: kept.select(F.col(c).alias("item"), (F.col("wins") + F.col("losses")).alias("n"))
    items = games("x").union(games("y")).groupBy("item").agg(F.sum("n").cast("long").alias("comparisons")).orderBy("item").toPandas()
    items["number"] = np.arange(len(items), dtype=np.int32)
    numbers = spark.createDataFrame(items[["item", "number"]], "item string, number int")
    ends = lambda x, to: numbers.select(F.col("item").alias(x), F.col("number").alias(to))
    numbered = materialize(kept.join(ends("x", "i"), "x").join(ends("y", "j"), "y").select("i", "j", "wins", "losses"), "numbered")
    parts = numbered.count() // PART_ROWS + 1
    beta, errors = fit(Pairs(numbered.coalesce(parts), len(items), link, ridge, max_sent), len(items), errors)
    found = pd.DataFrame({"item": items["item"], "strength": beta, "std_error": errors, "comparisons": items["comparisons"]})
    return spark.createDataFrame(found, "item string, strength double, std_error double, comparisons long")


def policy_games(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Wins and losses of each pair of policies (x < y).

    ``records`` (record_id, list_id, i, j, winner), ``owners`` (list_id, pos, policy). A record counts once, however
    often it is delivered (differing deliveries: the smallest of (list_id, i, j, winner)); records whose winner is
    null or neither i nor j, with a null among the ids, without an owner, or of a policy against itself say
    nothing. Of a repeated position the first policy name counts. Rows without record_id count one by one. Other
    columns are not read; empty tables give no pairs. Records are summed per (list, i, j, winner) before the join,
    so a list that holds a third of them adds no more rows than a small one.
    """
    valid = records.where("(winner = i or winner = j) and i <> j and list_id is not null").select("record_id", "list_id", "i", "j", "winner")
    known = valid.where("record_id is not null").groupBy("record_id").agg(F.min(F.struct("list_id", "i", "j", "winner")).alias("r")).select("r.*")
    once = known.union(valid.where("record_id is null").select("list_id", "i", "j", "winner"))
    loser = F.when(F.col("winner") == F.col("i"), F.col("j")).otherwise(F.col("i"))
    votes = once.groupBy("list_id", F.col("winner").alias("w"), loser.alias("l")).agg(F.count("*").alias("n"))
    by_pos = owners.where("list_id is not null and pos is not null and policy is not null").groupBy("list_id", "pos").agg(F.min("policy").alias("policy"))
    names = by_pos.groupBy("list_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "policy"))).alias("names"))
    named = votes.join(names, "list_id").select(F.try_element_at("names", "w").alias("w"), F.try_element_at("names", "l").alias("l"), "n").where("w is not null and l is not null and w <> l")
    x, y, won = F.least("w", "l"), F.greatest("w", "l"), F.col("w") < F.col("l")
    return named.groupBy(x.alias("x"), y.alias("y")).agg(F.sum(F.when(won, F.col("n")).otherwise(0)).alias("wins"), F.sum(F.when(won, 0).otherwise(F.col("n"))).alias("losses"))


def ranking(strength: DataFrame, policies: DataFrame) -> DataFrame:
    """(place, policy, strength, std_error, comparisons): all policies; those that never met have the prior's strength 0.

    Equal strengths are placed by name. The window over all items is a global sort; it holds one row per item.
    """
    from pyspark.sql import Window

    every = policies.select("policy").where("policy is not null").union(strength.select("item")).distinct()
    joined = every.join(strength.withColumnRenamed("item", "policy"), "policy", "left").fillna({"strength": 0.0, "comparisons": 0})
    place = F.row_number().over(Window.orderBy(F.col("strength").desc(), "policy"))
    return joined.select(place.alias("place"), "policy", "strength", "std_error", "comparisons")
