"""Reliabilities of voting rules by expectation-maximisation over counted vote patterns.

A rule votes 1 (for), -1 (against) or 0 (abstains). Spark counts the rows of each pattern of votes; there are at most
3 ** rules patterns whatever the number of rows, so the counts may come to the driver. The model is naive Bayes with
a hidden class: each class has a probability, and each rule a probability of each vote in each class.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, *, start: Callable[[tuple[int, ...]], float] | None = None, rounds: int = 100, smooth: float = 1.0) -> tuple[float, list[dict[int, float]]]:
    """(log odds of the class before votes, log odds added by each vote of each rule), from (votes, count) pairs.

    Starts from ``start``, the first probability of a pattern, or else from the majority of the votes. Without patterns
    every log odds is that of the votes themselves (+1, 0, -1).
    """
    if not patterns:
        return 0.0, [{v: float(v) for v in VOTES} for _ in range(rules)]
    start = start or (lambda votes: sigmoid(1.5 * sum(votes)))
    post = [start(votes) for votes, _ in patterns]
    prior, odds = 0.0, []
    for _ in range(rounds):
        yes = sum(n * p for (_, n), p in zip(patterns, post, strict=True))
        total = sum(n for _, n in patterns)
        prior = math.log((yes + smooth) / (total - yes + smooth))
        odds = []
        for j in range(rules):
            cells = {v: [smooth, smooth] for v in VOTES}
            for (votes, n), p in zip(patterns, post, strict=True):
                cells[votes[j]][0] += n * p
                cells[votes[j]][1] += n * (1 - p)
            a, b = (sum(c[k] for c in cells.values()) for k in (0, 1))
            odds.append({v: math.log(c[0] / a) - math.log(c[1] / b) for v, c in cells.items()})
        before, post = post, [posterior(prior, odds, votes) for votes, _ in patterns]
        if max(abs(p - q) for p, q in zip(before, post, strict=True)) < 1e-9:
            break
    return prior, odds


def posterior(prior: float, odds: list[dict[int, float]], votes: tuple[int, ...]) -> float:
    return sigmoid(prior + sum(o[v] for o, v in zip(odds, votes, strict=True)))


def choice(vote: Column, weights: dict) -> Column:
    """The weight of a vote (or other small set of values) as a column; others weigh 0."""
    first, *rest = weights.items()
    out = F.when(vote == first[0], F.lit(float(first[1])))
    for value, weight in rest:
        out = out.when(vote == value, F.lit(float(weight)))
    return out.otherwise(F.lit(0.0))


def posterior_column(prior: float, odds: list[dict[int, float]], votes: list[Column]) -> Column:
    total = F.lit(float(prior))
    for vote, weights in zip(votes, odds, strict=True):
        total = total + choice(vote, weights)
    return 1 / (1 + F.exp(-total))


def vote(against: Column, favour: Column) -> Column:
    """-1 where ``against`` holds, else 1 where ``favour`` holds, else 0 (also where either is null)."""
    return F.when(against, -1).when(favour, 1).otherwise(0)
