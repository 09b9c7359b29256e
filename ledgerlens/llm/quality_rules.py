"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Only DataFrame functions touch the rows. :func:`statistics` adds a struct of counts of a text, :data:`RULES` turns it into
votes, the counted vote patterns (at most 3 ** rules) fit the hidden-class model of :mod:`weak_labels` on the driver,
and the posterior probability of good quality is a column expression of the votes.

Null or empty texts have all counts 0 and fail the base rule (fewer than 50 words). Repeated rows give repeated
results, an empty table an empty result; extra columns pass through, and the added column never hides one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak_labels
from .common import fresh_name
from .weak_labels import vote

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Vote of each rule on the statistics struct.
RULES = {
    "length": lambda s: vote(s["n_words"] < MIN_WORDS, s["n_words"] >= 2 * MIN_WORDS),
    "symbols": lambda s: vote(s["n_symbols"] > 0.2 * s["n_words"], s["n_symbols"] <= 0.05 * s["n_words"]),
    "repeats": lambda s: vote(s["n_repeat_words"] > 0.4 * s["n_words"], s["n_repeat_words"] <= 0.15 * s["n_words"]),
    "lines": lambda s: vote(s["n_dup_lines"] > 0.4 * s["n_lines"], (s["n_lines"] >= 4) & (s["n_dup_lines"] <= 0.2 * s["n_lines"])),
    "capitals": lambda s: vote(s["n_upper"] > 0.4 * s["word_chars"], s["n_upper"] <= 0.15 * s["word_chars"]),
    "vocabulary": lambda s: vote((s["n_words"] >= MIN_WORDS) & (s["n_words"] < 1000) & (s["n_distinct"] < 0.3 * s["n_words"]), s["n_distinct"] >= 0.5 * s["n_words"]),
    "word_length": lambda s: vote((s["word_chars"] < 3 * s["n_words"]) | (s["word_chars"] > 10 * s["n_words"]), (s["word_chars"] >= 4.2 * s["n_words"]) & (s["word_chars"] <= 7 * s["n_words"])),
    "letters": lambda s: vote(s["n_bare"] > 0.15 * s["n_words"], s["n_bare"] <= 0.03 * s["n_words"]),
    "marks": lambda s: vote(s["n_ends"] < 0.1 * s["n_lines"], s["n_ends"] >= 0.5 * s["n_lines"]),
}


def statistics(docs: DataFrame, text_col: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` with struct ``into`` of counts: words, their characters, symbols, repeats, lines, capitals."""
    into = into or fresh_name(docs, "statistics")
    text, words, grams = (fresh_name(docs, x) for x in ("_t", "_w", "_g"))
    out = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = out.withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != ""))
    w, t = F.col(words), F.col(text)
    # Three-word windows as (hash, position), equal ones side by side after the sort.
    gram = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn(grams, F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram))).otherwise(none))
    g = F.col(grams)
    again = F.filter(g, lambda x, k: ((k > 0) & (F.get(g, k - 1)["h"] == x["h"])) | (F.get(g, k + 1)["h"] == x["h"]))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.concat_ws("", w)),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_bare": F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))),
        "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        "n_ends": F.size(F.filter(lines, lambda x: x.rlike(r"""[.!?:;"')\]][\x20\x09-\x0D]*$"""))),
    }
    made = F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(into))


def base_failed(s: Column) -> Column:
    """Too short, or more than half of the words in repeated three-word windows."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(counted: DataFrame, stats_col: str) -> tuple[float, list[dict[int, float]]]:
    """The vote model from all rows that have ``stats_col``; starts where all-must-pass filtering stands."""
    names = [f"v{k}" for k in range(len(RULES))]
    votes = counted.select(*[rule(F.col(f"`{stats_col}`")).alias(n) for n, rule in zip(names, RULES.values(), strict=True)])
    patterns = [(tuple(r[n] for n in names), r["rows"]) for r in votes.groupBy(*names).agg(F.count("*").alias("rows")).collect()]
    return weak_labels.fit(sorted(patterns), len(RULES), start=lambda votes: 0.1 if -1 in votes else 0.9)


def probability(model: tuple[float, list[dict[int, float]]], s: Column) -> Column:
    return weak_labels.posterior_column(*model, [rule(s) for rule in RULES.values()])
