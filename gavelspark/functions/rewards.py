"""Rewards of one completion against its list: Column -> Column, no Python in the plan.

A null completion scores as an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelspark.functions import text as X

_THINK = r"(?s)^<think>(?!.*<think>).*?</think>\s*\\boxed\{"
_END = r"\}\n?\z"
# The ladder of rewards by rank, before sorting.
LADDER = (1.0, -0.8, -0.6, -0.4, -0.2)


def _given(c: Column) -> Column:
    return X.strip(F.coalesce(c, F.lit("")))


def overlong_penalty(length: Column, longest: int, cache: int) -> Column:
    """0 up to longest - cache, then falling to -1 at ``longest``, and -1 beyond."""
    free = longest - cache
    return F.when(length <= free, 0.0).when(length <= longest, (F.lit(free) - length) / F.lit(float(cache))).otherwise(-1.0)


def _matches(c: Column, pattern: Column | str) -> Column:
    return F.regexp_like(c, pattern if isinstance(pattern, Column) else F.lit(pattern))


def list_format(c: Column, n: Column) -> Column:
    """0 for one think block followed by a box with one of the first ``n`` letters and nothing else, -1 otherwise."""
    box = F.concat(F.lit("[A-"), X.letter(n - 1), F.lit("]"))
    return F.when(_matches(_given(c), F.concat(F.lit(_THINK), box, F.lit(_END))), 0.0).otherwise(-1.0)


def list_correct(c: Column, chosen: Column) -> Column:
    """1 if the box after the thinking holds the chosen letter, else 0."""
    return F.when(X.boxed_text(X.post_think(F.coalesce(c, F.lit("")))) == chosen, 1.0).otherwise(0.0)


def list_format_cot(c: Column, n: Column) -> Column:
    """0 if the text ends with a box with one of the first ``n`` letters, -1 otherwise."""
    box = F.concat(F.lit(r"\\boxed\{[A-"), X.letter(n - 1), F.lit("]" + _END))
    return F.when(_matches(_given(c), box), 0.0).otherwise(-1.0)


def list_correct_cot(c: Column, chosen: Column) -> Column:
    """1 if the first box of the whole text holds the chosen letter, else 0."""
    return F.when(X.boxed_text(_given(c)) == chosen, 1.0).otherwise(0.0)


def list_distance(c: Column, pass_rates: Column, n: Column) -> Column:
    """Reward of the rank that the chosen letter's candidate has by pass rate (ties: earlier letter first); -1 for others.

    Without pass rates every letter is unknown.
    """
    count = F.least(n, F.size(pass_rates), F.lit(5))
    at = X._letter_place(X.boxed_text(X.post_think(F.coalesce(c, F.lit("")))))
    mine = F.get(pass_rates, at)
    first = F.slice(pass_rates, F.lit(1), F.greatest(count, F.lit(0)))
    before = F.size(F.filter(F.transform(first, lambda x, i: (x > mine) | ((x == mine) & (i < at))), lambda x: x))
    ladder = F.sort_array(F.slice(F.array(*[F.lit(x) for x in LADDER]), F.lit(1), F.greatest(n, F.lit(0))), asc=False)
    return F.when((at < count) & mine.isNotNull(), F.get(ladder, before)).otherwise(-1.0)


def listsc_correct(c: Column, n: Column, chosen_position: Column) -> Column:
    """2 if the only best of exactly ``n`` scores is the chosen candidate and scores 10, 1 if it scores less, -1 otherwise."""
    scores = X.boxed_scores(X.post_think(F.coalesce(c, F.lit(""))))
    right = X.top_index(scores, n) == chosen_position
    return F.when(right & (F.array_max(scores) == 10), 2.0).when(right, 1.0).otherwise(-1.0)


def pairsc_content(c: Column, pass_rates: Column) -> Column:
    """Order, exactness and confidence of two scores against ten times the pass rates; -2 without two scores or rates."""
    s = X.boxed_scores(X.post_think(F.coalesce(c, F.lit(""))))
    a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    ga, gb = (F.rint(F.get(pass_rates, F.lit(k)) * 10) for k in (0, 1))
    ordered = F.signum((a - b).cast("double")) == F.signum(ga - gb)
    off = F.abs(a - ga) + F.abs(b - gb)
    rel = F.when(ordered, 2.0).otherwise(-1.5)
    exact = F.when(off == 0, 1.0).when(ordered & (off <= 2), 0.6).otherwise(0.0)
    sure = F.when(ordered & (F.abs(a - b) >= F.abs(ga - gb)), 0.2).otherwise(0.0)
    return F.when((F.size(s) == 2) & ga.isNotNull() & gb.isNotNull(), F.round(rel + exact + sure, 2)).otherwise(-2.0)


def pairsc_format(c: Column) -> Column:
    """1 for one think block and a box with two scores from 0 to 10, -0.5 if a score is larger, -1 otherwise."""
    formed = _matches(_given(c), _THINK + r"\[\d+,\s*\d+\]" + _END)
    s = X.boxed_scores(X.post_think(F.coalesce(c, F.lit(""))))
    two = formed & (F.size(s) == 2)
    return F.when(two & F.forall(s, lambda x: x.between(0, 10)), 1.0).when(two, -0.5).otherwise(-1.0)


def listsc_format(c: Column, n: Column) -> Column:
    """0 for one think block and a box with exactly ``n`` scores, -1 otherwise."""
    numbers = F.concat(F.lit(r"\[\d+"), F.repeat(F.lit(r",\s*\d+"), n - 1), F.lit(r"\]"))
    return F.when(_matches(_given(c), F.concat(F.lit(_THINK), numbers, F.lit(_END))), 0.0).otherwise(-1.0)


def reward_set(model_path: Column, loss: Column) -> Column:
    """Names of the rewards that a run uses: by model (thinking or not), and the length penalty for two of the losses."""
    thinking = F.contains(F.lower(model_path), F.lit("deepseek"))
    base = F.when(thinking, F.array(F.lit("list_correct"), F.lit("list_format"))).otherwise(F.array(F.lit("list_correct_cot"), F.lit("list_format_cot")))
    return F.when(loss.isin("dapo", "bnpo"), F.array_append(base, F.lit("overlong_penalty"))).otherwise(base)


def overlong_cache(longest: int) -> int:
    """The part of the length over which the penalty falls."""
    return 1024 if longest <= 4096 else 2048
