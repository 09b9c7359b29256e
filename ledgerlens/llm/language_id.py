"""Language identification by Bayesian fusion of evidence.

The probability of a language given a row combines
 - the text: letter trigrams a text holds, under trigram frequencies counted per declared language over all rows,
 - the declared language of the markup (or column), under a confusion table of declared against textual language,
 - the address: priors of host, domain and address suffix, each smoothed towards the level above, from counts by grouped
   aggregation of the textual languages of all rows.

Languages are the declared primary subtags (``[a-z]{2,3}``) of at least ``min_rows`` rows (in small tables, of a share
``min_share`` of the rows). Beside them stands a background of uniform trigrams for noise, code and languages that are not
declared: it has a prior of ``background`` and takes part in the probability. Hosts are unbounded and stay distributed: their priors are joined, and broadcast
only while their number is under ``broadcast_hosts``.

A row is accepted if its text has a letter trigram and the best language at least ``min_probability``: by default, if it
is as likely as all others together. Where the background is likelier (or explains the text better, if the
row does not declare the language), or a language is declared that has no model, the language is ``und`` and the row not accepted: a declared language is never replaced unless it was compared. Null
or empty texts have no textual evidence and are not accepted; null or malformed declared languages, addresses and hosts
give no evidence. Without any declared language every row is ``und`` and none is accepted. Repeated rows give repeated
results, an empty table an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, shared_dir, slices, small_batches

BUCKETS = 1 << 14
UNIFORM = -math.log(BUCKETS)
#: Letters stay (ASCII in lower case), other ASCII bytes become a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("score", T.ArrayType(T.FloatType()))])


def held(texts: list[bytes | None]) -> np.ndarray:
    """Which trigram buckets each text holds (texts x buckets); trigrams of spaces only are left out."""
    out = np.zeros((len(texts), BUCKETS), np.bool_)
    for k, text in enumerate(texts):
        if text:
            b = np.frombuffer(b" " + text.translate(TABLE) + b" ", np.uint8).astype(np.uint32)
            code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            code = code[code != 0x202020]
            out[k, (code * np.uint32(2654435761)) >> np.uint32(18)] = True
    return out


def subtag(declared: Column) -> Column:
    """Primary subtag of a declared language in lower case; null where there is none."""
    found = F.regexp_extract(F.lower(declared), r"^\s*([a-z]{2,3})(?:[-_][a-z0-9_-]*)?\s*$", 1)
    return F.when(found != "", found)


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets

    def score(self, texts: list[bytes | None], temper: float) -> tuple[np.ndarray, np.ndarray]:
        """(number of distinct trigrams, log likelihood of each language) per text; trigrams are dependent: tempered."""
        n, out = np.zeros(len(texts), np.int32), np.zeros((len(texts), len(self.languages)), np.float32)
        for k in range(0, len(texts), 256):
            flags = held(texts[k:k + 256])
            n[k:k + 256] = flags.sum(1)
            out[k:k + 256] = flags.astype(np.float32) @ self.log_p.T * temper
        return n, out


def fit_text(rows: DataFrame, text_col: str, declared: Column, *, min_share: float = 1e-4, min_rows: int = 20) -> TextModel:
    """Trigram frequencies per declared language, counted over all rows."""
    small_batches(rows.sparkSession)
    tagged = rows.select(F.col(f"`{text_col}`").cast("binary").alias("text"), subtag(declared).alias("language")).where("language is not null")
    by = {r["language"]: r["n"] for r in tagged.groupBy("language").agg(F.count("*").alias("n")).where(F.col("n") > 0).collect()}
    total = sum(by.values())
    languages = sorted(k for k, n in by.items() if n >= min(min_rows, min_share * total))
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS), np.float32))
    index = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for at, length in slices(batch.column(0), 1 << 20):
                texts, tags = (batch.column(c).slice(at, length).to_pylist() for c in (0, 1))
                for k in range(0, length, 256):
                    flags = held(texts[k:k + 256])
                    which = np.array([index[t] for t in tags[k:k + 256]])
                    for i in np.unique(which):
                        seen[i] += flags[which == i].sum(0)
        for i, row in seen.items():
            b = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, np.int32)), pa.array(b.astype(np.int32)), pa.array(row[b])], names=["i", "b", "n"])

    counts = tagged.where(F.col("language").isin(languages)).mapInArrow(run, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n"))
    seen = np.full((len(languages), BUCKETS), 0.5)
    i, b, n = (c.to_numpy() for c in counts.toArrow().columns)  # at most languages x buckets
    seen[i, b] += n
    return TextModel(languages, np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32))


def scored(rows: DataFrame, model: TextModel, text_col: str, into: str, temper: float) -> DataFrame:
    """``rows`` with struct ``into`` (RESULT). Only texts go to Python and only scores come back; the other columns stay in the JVM."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(texts.slice(at, length).to_pylist(), temper) for at, length in slices(texts, 1 << 20)]
        n, out = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else shared.value.score([], temper)
        width = out.shape[1]
        score = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * width + 1, max(1, width), dtype=np.int32) if width else np.zeros(len(texts) + 1, np.int32)), pa.array(out.ravel(), pa.float32()))
        return pa.StructArray.from_arrays([pa.array(n), score], names=["n", "score"])

    # Nondeterministic to the optimizer, so that no filter or projection above runs it a second time.
    score = F.arrow_udf(run, RESULT).asNondeterministic()
    return rows.withColumn(into, score(F.col(f"`{text_col}`").cast("binary")))


def best(score: Column, languages: list[str]) -> Column:
    """Language of the highest score; the first of equal ones."""
    return F.element_at(F.array(*[F.lit(k) for k in languages]), F.array_position(score, F.array_max(score)).cast("int"))


def domain(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def identify(rows: DataFrame, *, text_col: str, declared: Column, host: Column, into: str | None = None, min_probability: float = 0.5,
             temper: float = 0.15, weight: float = 5.0, min_share: float = 1e-4, min_rows: int = 20, background: float = 1e-5, broadcast_hosts: int = 20_000,
             text_model: TextModel | None = None) -> DataFrame:
    """``rows`` with struct ``into``: ``language``, ``probability``, ``text_language``, ``accepted``.

    ``weight`` is the number of rows that the level above counts as in a smoothed prior.
    """
    into = into or fresh_name(rows, "language")
    model = text_model or fit_text(rows, text_col, declared, min_share=min_share, min_rows=min_rows)
    languages = model.languages
    if not languages:
        made = F.struct(F.lit("und").alias("language"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_language"), F.lit(False).alias("accepted"))
        return rows.withColumn(into, made)
    text, tag, at = (fresh_name(rows, c) for c in ("_text_score", "_declared", "_host"))
    base = scored(rows.withColumn(tag, subtag(declared)).withColumn(at, F.lower(host)), model, text_col, text, temper)
    noise = F.col(text)["n"] * (UNIFORM * temper)  # log likelihood of the background
    label = F.when((F.col(text)["n"] > 0) & (F.array_max(F.col(text)["score"]) >= noise), best(F.col(text)["score"], languages))
    compared = F.col(tag).isNull() | F.col(tag).isin(languages)
    seen = base.where(compared).select(F.col(at).alias("host"), F.col(tag).alias("declared"), label.alias("label")).where("label is not null").groupBy("host", "declared", "label").agg(F.count("*").alias("n"))
    # The counts are read three times, the texts behind them once: cut here (reliable checkpoint in the shared folder).
    spark = rows.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    seen = seen.checkpoint()
    confusion = log_confusion(seen, languages)
    priors = log_priors(seen, languages, weight)
    known = priors["hosts"]
    if known.count() <= broadcast_hosts:
        known = F.broadcast(known)
    prior = fresh_name(rows, "_prior")
    out = base.join(known.select(F.col("host").alias(at), F.col("prior").alias(prior)), at, "left")
    by_host = F.coalesce(F.col(prior), F.array(*[F.lit(x) for x in priors["all"]]))
    given = fresh_name(rows, "_given")
    tags = spark.createDataFrame([(d, confusion[d]) for d in languages], f"`{tag}` string, `{given}` array<double>")
    out = out.join(F.broadcast(tags), tag, "left")
    by_tag = F.coalesce(F.col(given), F.array_repeat(F.lit(0.0), len(languages)))
    total = F.transform(F.arrays_zip(F.col(text)["score"].alias("t"), by_host.alias("h"), by_tag.alias("d")), lambda x: x["t"].cast("double") + x["h"] + x["d"])
    score = fresh_name(rows, "_score")
    out = out.withColumn(score, total)
    s = F.col(score)
    other = noise + math.log(background) - F.when(F.col(tag).isNull(), 0.0).otherwise(math.log(len(languages)))
    likeliest = F.array_max(s)
    top = F.greatest(likeliest, other)
    probability = F.exp(likeliest - top) / (F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)) + F.exp(other - top))
    # A language that the row does not declare itself must explain the text better than the background does.
    backed = F.element_at(F.col(text)["score"], F.array_position(s, likeliest).cast("int")) >= noise
    judged = compared & (likeliest >= other) & (backed | F.coalesce(F.col(tag) == best(s, languages), F.lit(False)))
    made = F.struct(F.when(judged, best(s, languages)).otherwise("und").alias("language"), probability.alias("probability"), F.coalesce(best(F.col(text)["score"], languages), F.lit("und")).alias("text_language"),
                    ((F.col(text)["n"] > 0) & judged & (probability >= min_probability)).alias("accepted"))
    return out.withColumn(into, made).select(*[F.col(f"`{c}`") for c in rows.columns], into)


def log_confusion(seen: DataFrame, languages: list[str]) -> dict[str, list[float]]:
    """log P(declared | language) for each declared language, from the textual languages of all rows."""
    rows = seen.where(F.col("declared").isin(languages)).groupBy("declared", "label").agg(F.sum("n").alias("n")).collect()
    n = {(r["declared"], r["label"]): r["n"] for r in rows}
    total = {k: sum(n.get((d, k), 0) for d in languages) for k in languages}
    return {d: [math.log((n.get((d, k), 0) + (1.0 if d == k else 0.1)) / (total[k] + 1 + 0.1 * len(languages))) for k in languages] for d in languages}


def log_priors(seen: DataFrame, languages: list[str], weight: float) -> dict:
    """Log priors: ``all`` rows (a list), and a frame of ``hosts`` smoothed towards domain, suffix and all rows."""
    counts = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i, k in enumerate(languages)]
    cols = [f"c{i}" for i in range(len(languages))]
    hosts = seen.where("host is not null and host <> ''").groupBy("host").agg(*counts).withColumn("domain", domain(F.col("host")))
    hosts = hosts.withColumn("suffix", F.substring_index("host", ".", -1))
    sums = [F.sum(c).alias(c) for c in cols]
    total = seen.agg(*counts).first()
    n = [(total[c] or 0.0) + 1.0 for c in cols]
    p_all = [x / sum(n) for x in n]

    def smoothed(frame: DataFrame, above: list[Column], name: str) -> DataFrame:
        frame = frame.withColumn("rows", F.aggregate(F.array(*cols), F.lit(0.0), lambda acc, x: acc + x))
        return frame.withColumn(name, F.array(*[(F.col(c) + weight * a) / (F.col("rows") + weight) for c, a in zip(cols, above, strict=True)]))

    suffixes = smoothed(hosts.groupBy("suffix").agg(*sums), [F.lit(p) for p in p_all], "p_suffix").select("suffix", "p_suffix")
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")
    domains = smoothed(domains, [F.col("p_suffix")[i] for i in range(len(cols))], "p_domain").select("domain", "p_domain")
    out = smoothed(hosts.join(domains, "domain"), [F.col("p_domain")[i] for i in range(len(cols))], "p")
    return {"all": [math.log(p) for p in p_all], "hosts": out.select("host", F.transform("p", lambda x: F.log(x)).alias("prior"))}


def page_text(html: Column) -> Column:
    """Rough text of a page: scripts, styles and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")


def page_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z_-]+)", 1)


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
