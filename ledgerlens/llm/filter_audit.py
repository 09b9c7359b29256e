"""Filter interaction audit: what each of five filters removes in every order, from one sparse document-term matrix.

Failure conditions: A fewer than ``min_words`` words, B distinct words under half of the words, C more than 3 % capital letters A-Z among the
code points, D one of ``#$%&*|``, E identical to the text of a row with a smaller key anywhere in the table. Words are maximal
runs without ASCII white space, case-sensitive. Row sums of the matrix (``term_matrix``) give the words, its entries the distinct ones.

A row's outcome depends only on the set of filters it fails, so rows are counted per part and set (32 at most) before any order is looked
at; the 120 orders are sums over those counts. Copies (E) are found from the texts' SHA-256: rows are counted per text, part, flags
and labels, with the smallest key and the rows that have it, and only these counts meet per text, so a text that a third of all rows hold is no
large group.

Null texts count as empty (they fail A, are identical to each other and to empty ones). A null part is the empty string. A row with a null key
has no smaller key: it does not fail E, and has no labels. Rows of one key and text are not copies of each other. Where
labels repeat a key, one row with 1 is enough. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import term_matrix

FILTERS = "ABCDE"
# The limits of the five filters.
MIN_WORDS, DISTINCT_PCT, CAPITAL_PCT, SYMBOLS = 200, 50, 3, b"#$%&*|"

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_DERIVED = T.StructType([T.StructField("_digest", T.BinaryType()), T.StructField("_capitals", T.BooleanType()), T.StructField("_symbols", T.BooleanType())])


def _derive(text: bytes) -> tuple[bytes, bool, bool]:
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return hashlib.sha256(text).digest(), 100 * capitals > CAPITAL_PCT * len(text.decode("utf-8", "replace")), len(text.translate(None, SYMBOLS)) < len(text)


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def flags(docs: DataFrame, *, key: str = "doc_id", text_col: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, digest of the text, fails: bits of the filters A to D) per row, through the document-term matrix."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("_text"))
    s = term_matrix.Matrix(rows, "_text", derive=_derive, derived=_DERIVED, keep_words=False).row_statistics()
    fails = (F.when(F.col("n_words") < MIN_WORDS, _bit("A")).otherwise(0) + F.when(100 * F.col("n_distinct") < DISTINCT_PCT * F.col("n_words"), _bit("B")).otherwise(0)
             + F.when(F.col("_capitals"), _bit("C")).otherwise(0) + F.when(F.col("_symbols"), _bit("D")).otherwise(0))
    return s.select("key", "part", F.col("_digest").alias("digest"), fails.alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``rows`` with booleans good and toxic. Rows without a key are spread by their text and meet no label."""
    one = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    one = one.withColumn("label_spread", F.lit(0).cast("long"))
    spread = F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(0)
    met = rows.withColumn("spread", spread).join(one, (F.col("key") == F.col("label_key")) & (F.col("spread") == F.col("label_spread")), "left")
    return met.select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def failure_counts(rows: DataFrame) -> DataFrame:
    """(part, fails with E, good, toxic, n) from (key, part, digest, fails, good, toxic)."""
    kind = ["part", "fails", "good", "toxic"]
    per_key = rows.groupBy("digest", "key", *kind).agg(F.count(F.lit(1)).alias("n"))
    has_key = F.col("key").isNotNull()
    per_text = per_key.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.min(F.when(has_key, F.struct("key", "n"))).alias("first"), F.sum(F.when(~has_key, F.col("n")).otherwise(0)).alias("keyless"))
    # Rows of a text meet here as counts: at most one per part and labels, as A to D depend on the text alone.
    least = F.min("first.key").over(Window.partitionBy("digest"))
    unique = F.col("keyless") + F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    split = per_text.withColumn("least", least).select(*kind, F.inline(F.array(F.struct(F.lit(0).alias("copy"), unique.alias("m")), F.struct(F.lit(_bit("E")).alias("copy"), (F.col("n") - unique).alias("m")))))
    return split.groupBy("part", (F.col("fails") + F.col("copy")).alias("fails"), "good", "toxic").agg(F.sum("m").alias("n"))


def _total(counts: str, where) -> Column:
    """Sum of the counts of all sets of filters for which ``where`` holds."""
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), where)
    return F.aggregate(sets, F.lit(0).cast("long"), lambda total, m: total + F.element_at(counts, m + 1))


def orders(counts: DataFrame) -> DataFrame:
    """The audit from the counts per part and set of failed filters: a row per part, order of the filters and step."""
    n_sets = 1 << len(FILTERS)

    def per_set(where: Column) -> Column:
        return F.array(*[F.sum(F.when((F.col("fails") == m) & where, F.col("n")).otherwise(0)) for m in range(n_sets)])

    parts = counts.groupBy("part").agg(per_set(F.lit(True)).alias("all"), per_set(F.col("good")).alias("good"), per_set(F.col("toxic")).alias("bad"))
    every = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.create_map(*[F.lit(x) for f in FILTERS for x in (f, _bit(f))])
    before = F.aggregate(F.split(F.expr("substring(filter_order, 1, step - 1)"), ""), F.lit(0), lambda acc, f: acc + F.coalesce(F.try_element_at(bits, f), F.lit(0)))
    rows = steps.withColumn("bit", F.element_at(bits, F.expr("substring(filter_order, step, 1)"))).withColumn("before", before)
    fails, earlier = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    here = lambda m: fails(m) & ~earlier(m)
    # In 1 of k of all orders a given one of a row's k failed filters comes first.
    fact = len(list(permutations(FILTERS)))
    shapley = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(n_sets - 1)), fails), F.lit(0).cast("long"),
                          lambda total, m: total + (F.element_at("all", m + 1) * F.lit(fact) / F.bit_count(m)).cast("long"))
    return rows.select("part", "filter_order", "step", _total("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), _total("all", here).alias("removed"),
                       _total("all", lambda m: fails(m) & earlier(m)).alias("redundant"), F.element_at("all", F.col("bit") + 1).alias("unique_fails"),
                       _total("good", here).alias("good_lost"), _total("bad", here).alias("toxic_lost"), shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text_col: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return orders(failure_counts(labelled(flags(docs, key=key, text_col=text_col, part=part), labels, key=key)))
