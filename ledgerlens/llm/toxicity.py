"""Toxic spans and document scores by a linear-chain conditional random field.

Each sentence of a text is a chain of words with two states, ordinary and toxic. A word's features (itself, and its
prefixes where the word goes on) give its emission, neighbouring states a transition; forward-backward marginals tag
toxic spans, and a document's score is the probability that any of its ``EVIDENCE`` most suspicious words is toxic (noisy-or of their
marginals), calibrated by a logistic line. A fixed number of words keeps the score from growing with the length of the text: the faint
doubt about every ordinary word would add up otherwise.

Training needs labelled tokens. They come from labelled documents: in a toxic document a word is toxic if one of its features
is found in toxic documents far more often than chance allows and seldom elsewhere, and half toxic if it is found elsewhere
too; all words of other documents are ordinary. Training runs on the driver on a hash sample of labelled documents, whole and of any
length: about ``train_toxic`` + ``train_clean`` of them at most, and about ``train_chars`` characters of each class in all (a documented
bound; the sample gets thinner for either). The logistic line is then fitted on all labelled documents, whose raw scores Spark
computes and counts in bins. Scoring reads every whole text.

Null or empty texts, and texts without letters, have the score of no toxic word. Labels that are null, or whose document is not
there, are left out; of several labels of one document the highest counts. Without any usable label nothing is known and
every score is 0. Repeated rows give repeated results, an empty table an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, fresh_name, written

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
PREFIXES = (4, 5, 6, 7)
#: Words of a document that count for its score.
EVIDENCE = 8
#: Raw scores are counted in bins of this width between these ends.
BIN, RAW_ENDS = 0.125, 12.0
#: At most so many words are remembered with their emission.
REMEMBER = 400_000

RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))),
])


def features(word: str) -> list[str]:
    """The word, and its prefixes where letters follow them."""
    return [word, *(word[:k] + "+" for k in PREFIXES if len(word) > k)]


def chains(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs between boundaries (NaN), longest first."""
    word = ~np.isnan(e)
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of toxic against ordinary from the left (own emission included) and from the right, for all words.

    ``e`` holds the emission odds, ``t`` the 2 x 2 transition weights; chains start in either state with weights 1 and
    ``t[0, 1] / t[0, 0]``. Chains advance together, one word a step; the longest come first.
    """
    left, right = np.zeros_like(e), np.ones_like(e)
    if not len(starts):
        return left, right
    most = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(most), "left")  # chains longer than the step
    (a, b), (c, d) = t
    here = e[starts] * (b / a)
    left[starts] = here
    for k in range(1, most):
        at = starts[:active[k]] + k
        prior = here[:active[k]]
        here = e[at] * (b + d * prior) / (a + c * prior)
        left[at] = here
    there = np.ones(0)
    for k in range(most - 2, -1, -1):
        n = active[k + 1]
        beyond = np.ones(n)
        beyond[:len(there)] = there
        at = starts[:n] + k
        ahead = e[at + 1] * beyond
        there = (c + d * ahead) / (a + b * ahead)
        right[at] = there
    return left, right


def log_tail(hits: int, n: int, p: float) -> float:
    """Upper bound (Chernoff) of the log probability of at least ``hits`` of ``n`` at rate ``p``."""
    share = hits / n
    if share <= p:
        return 0.0
    return -n * (share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0))


class Field:
    """The trained chain: feature weights, transitions, and the line that turns a noisy-or into a score."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, line: tuple[float, float] | None):
        self.weights, self.bias, self.transitions, self.line = weights, bias, transitions, line
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emission(self, token: str) -> float:
        """Emission odds of a token; NaN at a boundary."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            total = self.bias + sum(self.weights.get(f, 0.0) for f in features(token.lower())) if token not in STOPS else math.nan
            found = math.exp(min(total, 60.0)) if total == total else math.nan
            if len(token) <= 40:
                self.known[token] = found
        return found

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic probability of every token of all documents (0 at boundaries), and the documents' offsets."""
        get = self.emission
        sizes = [len(d) + 1 for d in docs]
        e = np.full(sum(sizes), np.nan)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        for k, d in enumerate(docs):
            e[offsets[k]:offsets[k + 1] - 1] = list(map(get, d))
        return self.probabilities(e), offsets

    def probabilities(self, e: np.ndarray) -> np.ndarray:
        left, right = forward_backward(e, *chains(e), self.transitions)
        odds = left * right
        return np.where(np.isnan(e), 0.0, odds / (1 + odds))

    def raw(self, p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds that any of a document's most suspicious words is toxic."""
        none = np.zeros(len(offsets) - 1)
        doubt = np.log1p(-np.minimum(p, 1 - 1e-9))
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            none[k] = (doubt[a:b] if b - a <= EVIDENCE else np.partition(doubt[a:b], EVIDENCE)[:EVIDENCE]).sum()
        return np.log(np.maximum(-np.expm1(none), 1e-12)) - np.maximum(none, -30)


def tokens(text: str) -> list[str]:
    """Words and boundaries as they stand in the text; features are those of the lower-cased word."""
    return TOKEN.findall(text)


def telling(docs: list[set[str]], toxic: list[int], *, log_chance: float = -11.0, support: int = 3) -> dict[str, float]:
    """Features that toxic documents hold more often, with the label their words get there: 1, 0.5 or, if chance may do it, 0.

    ``docs`` are the documents' distinct words. Only features with ``support`` toxic documents are counted in the others.
    """
    yes: Counter = Counter()
    for d, y in zip(docs, toxic, strict=True):
        if y:
            yes.update({f for w in d for f in features(w)})
    all_docs = Counter({f: n for f, n in yes.items() if n >= support})
    yes = Counter(all_docs)
    for d, y in zip(docs, toxic, strict=True):
        if not y:
            all_docs.update({f for w in d for f in features(w) if f in yes})
    rate = sum(toxic) / max(1, len(toxic))
    out = {}
    for f, n in yes.items():
        chance = log_tail(n, all_docs[f], rate)
        if chance <= -4:
            out[f] = 0.0 if chance > log_chance else 1.0 if n >= 0.7 * all_docs[f] else 0.5
    return out


def train(texts: list[str], toxic: list[int], weight: list[float], *, steps: int = 90) -> Field:
    """The field from labelled documents; ``weight`` undoes the sampling of the classes in the calibration."""
    nothing = Field({}, -12.0, np.array([[1.0, 0.01], [0.5, 0.5]]), None)
    if not texts or not 0 < sum(toxic) < len(texts):
        return nothing
    vocabulary: dict[str, int] = {"\n": 0}
    docs, held = [], []
    for t in texts:
        words = [w.lower() for w in tokens(t)]
        docs.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words] + [0], np.int32))
        held.append(docs[-1][np.unique(docs[-1], return_index=True)[1]])
    names = list(vocabulary)
    told = telling([{names[k] for k in d} - STOPS for d in held], toxic)
    index = {f: k for k, f in enumerate(sorted(told))}
    of_word = [[] if w in STOPS else [index[f] for f in features(w) if f in index] for w in names]
    label = np.array([max((told[f] for f in features(w) if f in told), default=0.0) if ids else 0.0 for w, ids in zip(names, of_word, strict=True)])
    flat = np.concatenate(docs)
    word = ~np.isin(flat, [vocabulary[x] for x in STOPS if x in vocabulary])
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    y = np.repeat(np.array(toxic, float), np.diff(offsets)) * label[flat]
    width = np.array([len(ids) for ids in of_word])
    first = np.concatenate([[0], np.cumsum(width)])
    held_by = np.array([i for ids in of_word for i in ids], np.int32)
    hot = np.flatnonzero(width[flat])
    rows = np.repeat(hot, width[flat[hot]])
    within = np.arange(len(rows)) - np.repeat(np.cumsum(width[flat[hot]]) - width[flat[hot]], width[flat[hot]])
    cols = held_by[first[flat[rows]] + within]
    starts, lengths = chains(np.where(word, 1.0, np.nan))
    w, bias, log_t = np.zeros(len(index)), -6.0, np.log(np.array([[0.99, 0.01], [0.9, 0.1]]))
    # Words that follow another in their chain: their transitions count.
    after = word.copy()
    after[starts] = False
    w, bias, log_t = climb(w, bias, log_t, y, word, rows, cols, starts, lengths, after, steps)
    field = Field({f: float(w[k]) for f, k in index.items()}, bias, np.exp(log_t), None)
    e = np.where(word, np.array([field.emission(w) for w in names])[flat], np.nan)
    p = field.probabilities(e)
    field.line = calibrated(field.raw(p, offsets), np.array(toxic, float), np.array(weight))
    return field


def climb(w, bias, log_t, y, word, rows, cols, starts, lengths, after, steps, rate=0.5, decay=0.5):
    """Adagrad steps up the likelihood of the labelled chains, with a Gaussian prior on the weights."""
    squares = [np.full(len(w), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    before = np.flatnonzero(after)
    first, second = (np.stack([1 - y[k], y[k]]) for k in (before - 1, before))
    seen = first @ second.T
    for _ in range(steps):
        total = np.full(len(word), bias)
        np.add.at(total, rows, w[cols])
        e = np.where(word, np.exp(np.minimum(total, 40)), np.nan)
        t = np.exp(log_t)
        left, right = forward_backward(e, starts, lengths, t)
        odds = np.where(word, left * right, 0.0)
        miss = np.where(word, y - odds / (1 + odds), 0.0)
        l, ahead = left[before - 1], e[before] * right[before]
        cells = [np.full(len(before), t[0, 0]), t[0, 1] * ahead, t[1, 0] * l, t[1, 1] * l * ahead]
        z = sum(cells)
        slope = [np.bincount(cols, miss[rows], len(w)) - decay * w, miss.sum(), seen - np.array([(c / z).sum() for c in cells]).reshape(2, 2)]
        moved = []
        for k, (value, g) in enumerate(zip((w, bias, log_t), slope, strict=True)):
            squares[k] = squares[k] + g * g
            moved.append(value + rate * g / np.sqrt(squares[k]))
        w, bias, log_t = moved
        bias = float(bias)
    return w, bias, log_t


def calibrated(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic line from raw log odds to the label; Newton steps."""
    x = np.stack([np.clip(raw, -RAW_ENDS, RAW_ENDS), np.ones(len(raw))], 1)
    at = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.01 * at
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        at = at + np.clip(np.linalg.solve(h, g), -1, 1)
    return max(0.0, float(at[0])), float(at[1])


def bucket(doc_id: Column) -> Column:
    """The part of the split a document is in: crc32 of its id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents outside the held-out part."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 2))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _trained(docs: DataFrame, known: DataFrame, train_toxic: int, train_clean: int, train_chars: int) -> Field:
    """The field from a hash sample, its line from the sample alone."""
    held = docs.select("doc_id", F.octet_length("text").alias("chars")).where("chars is not null").join(known, "doc_id")
    sizes = {r["toxic"]: (r["n"], r["chars"]) for r in held.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    share = {}
    for y, most in ((1, train_toxic), (0, train_clean)):
        n, chars = sizes.get(y, (0, 0))
        share[y] = min(1.0, most / max(1, n), train_chars / max(1, chars))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.where(F.when(F.col("toxic") == 1, part < share[1]).when(F.col("toxic") == 0, part < share[0]))
    # The chosen labels are bounded by the parameters, so they may be broadcast and no text is shuffled.
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = sorted((r["doc_id"], r["text"], int(r["toxic"])) for r in sample.collect())
    return train([t for _, t, _ in rows], [y for *_, y in rows], [1 / share[y] for *_, y in rows])


def _line(raw: DataFrame, known: DataFrame) -> tuple[float, float] | None:
    """The calibration from (doc_id, raw) of all labelled documents; two counts a bin come to the driver."""
    met = raw.join(known.where("toxic in (0, 1)"), "doc_id")
    seen = [(r["bin"] * BIN, int(r["toxic"]), r["count"]) for r in met.groupBy("toxic", F.round(F.col("raw") / BIN).cast("int").alias("bin")).count().collect()]
    return calibrated(*(np.array(x, float) for x in zip(*sorted(seen), strict=True))) if seen else None


def fit(docs: DataFrame, labels: DataFrame, *, train_toxic: int = 2000, train_clean: int = 3000, train_chars: int = 6_000_000) -> Field:
    """Train on a hash sample of the labelled documents outside the held-out part, calibrate on all of them."""
    known = _known(labels)
    field = _trained(docs, known, train_toxic, train_clean, train_chars)
    if field.line is not None:
        learned = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (bucket(F.col("doc_id")) != 2))
        field.line = _line(tagged(learned, field, into="t").select("doc_id", "t.raw"), known) or field.line
    return field


def fit_and_score(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, score, spans) of every row of ``docs``: as :func:`score` with :func:`fit`, but the texts are tagged once, the raw scores are
    stored, and the line is fitted on those."""
    known = _known(labels)
    field = _trained(docs, known, **({"train_toxic": 2000, "train_clean": 3000, "train_chars": 6_000_000} | bounds))
    if field.line is None:
        return score(docs.select("doc_id", "text"), field, into="t").select("doc_id", "t.score", "t.spans")
    raw = written(docs.sparkSession, tagged(docs.select("doc_id", F.col("text"), F.col("text").isNull().alias("none")), field, into="t").select("doc_id", "none", "t.raw", "t.spans"), "toxicity")
    line = _line(raw.where("not none").select("doc_id", "raw"), known) or field.line
    calibrated_score = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(line[0]) * F.col("raw") + F.lit(line[1])))))
    return raw.select("doc_id", calibrated_score.alias("score"), "spans")


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of toxic words as (start, end, highest probability); positions in code points of the text."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(TOKEN.finditer(text)):
        if p[k] >= least:
            if k == last + 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[k]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            last = k
    return out


TAGGED = T.StructType([T.StructField("raw", T.DoubleType()), RESULT["spans"]])


def tagged(docs: DataFrame, field: Field, text_col: str = "text", into: str = "tagged") -> DataFrame:
    """``docs`` with struct ``into``: the uncalibrated log odds ``raw``, within ``RAW_ENDS``, and the toxic ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(texts: list) -> pa.StructArray:
        field = shared.value
        plain = [x.decode("utf-8", "replace") if x else "" for x in texts]
        p, offsets = field.marginals([tokens(t) for t in plain])
        found = [spans(t, p[a:b]) if p[a:b].max(initial=0.0) >= 0.5 else [] for t, a, b in zip(plain, offsets[:-1], offsets[1:], strict=True)]
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
        raw = np.clip(field.raw(p, offsets), -RAW_ENDS, RAW_ENDS)
        return pa.StructArray.from_arrays([pa.array(raw, pa.float64()), pa.array(found, pa.list_(span))], names=["raw", "spans"])

    return append_struct(docs, text_col, run, TAGGED, into, slice_bytes=2 << 20)


def score(docs: DataFrame, field: Field, text_col: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` with struct ``into``: the ``score`` and the toxic ``spans``."""
    into = into or fresh_name(docs, "toxicity")
    out = tagged(docs, field, text_col, into)
    line, raw = field.line, F.col(into)["raw"]
    value = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(line[0]) * raw + F.lit(line[1]))))) if line else F.lit(0.0)
    return out.withColumn(into, F.struct(value.alias("score"), F.col(into)["spans"].alias("spans")))
