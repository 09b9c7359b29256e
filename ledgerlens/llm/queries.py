"""The operators over the test tables: query name -> (spark, sf_dir) callable, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_extract, language_id, ngram_join, pii, quality_rules, ranked_search, sentencepiece_codec, suffix_dedup, token_files, toxicity, url_rules
from .common import sha256_hex, shared_dir, table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(toxicity.bucket(F.col("doc_id")) == 2, F.lit(False))
    out = toxicity.fit_and_score(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), into="scan")
    out = scanned.select("doc_id", F.col("scan.n_words").alias("n_words"), decontaminate.n_hit("scan").alias("n_hit"), "scan.items")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      sha256_hex(F.concat_ws(",", "items")).alias("items_sha256"),
                      decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


OP2_SQL = r"""
WITH lower_items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lower_docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM lower_items WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, k, s.size, array_to_string(list_slice(w, k, k + s.size - 1), ' ') AS gram
  FROM (SELECT DISTINCT size FROM item_windows) s, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM lower_docs) d
  WHERE k + s.size - 1 <= len(w)
), found AS (
  SELECT doc_id, k, size, item_id FROM doc_windows JOIN item_windows USING (size, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lower_docs LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html, url = F.col("html"), F.col("url")
    rows = pages.select("page_id", "url", language_id.page_text(html).alias("text"), language_id.page_language(html).alias("declared"), language_id.page_host(url).alias("host"))
    out = language_id.identify(rows, text_col="text", declared=F.col("declared"), host=F.col("host"), into="l")
    return out.select("page_id", "url", "l.language", "l.probability", "l.text_language", "l.accepted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    out = token_files.read(spark, path, files, packed=True)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


# Links by counting common shingles per pair, components as the smallest doc_id reachable.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.detect(docs, into="p")
    count = lambda kind: F.size(F.filter("p.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(kind) for kind in pii.BASE], sha256_hex(pii.described(F.col("p.base"))).alias("base_sha256"),
                      pii.described(F.col("p.spans")).alias("spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), sha256_hex(F.col("kept")).alias("kept_sha256"))


# Every 50-byte string (as hexadecimal) with the smallest document that holds it; covered starts merge into runs.
OP7_SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM bytes)
), firsts AS (
  SELECT s, min(doc_id) AS first_doc FROM strings GROUP BY s
), covered AS (
  SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE first_doc < doc_id
), marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM covered
), numbered AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked
), runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
), kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_over
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The counts are small and needed twice, to fit and to decide: they are stored, the texts read once.
    counted = written(spark, quality_rules.statistics(docs, into="s").select("doc_id", "s"), "quality")
    s = F.col("s")
    failed = quality_rules.base_failed(s)
    good = quality_rules.probability(quality_rules.fit(counted, "s"), s)
    return counted.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", failed.alias("base_failed"),
                          (~failed & (good >= 0.5)).alias("kept"), good.alias("quality"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), into="p")
    return p.select("doc_id", F.size("p.ids").cast("long").alias("n_tokens"),
                    sha256_hex(F.array_join(F.col("p.ids").cast("array<string>"), " ")).alias("ids_sha256"),
                    sha256_hex(F.col("p.decoded")).alias("decoded_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = F.col("m.text")
    return html_extract.extract(pages, into="m").select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


# The entries of the URL query as (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, url = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(pages, rules, url, into="j").select("page_id", url_rules.host(url).alias("host"), url_rules.path(url).alias("path"), "j.rule", "j.verdict")


# Every fitting entry by a comparison of texts, the longest one first.
OP11_SQL = r"""
WITH rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, p, verdict)
), after AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after
), fits AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The filters applied row by row in every order: a row is removed at the first step whose filter it fails.
OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), judged AS (
  SELECT doc_id, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM texts
), marks AS (
  SELECT doc_id AS label_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END, CASE WHEN c THEN 'C' END,
                      CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM judged LEFT JOIN marks ON doc_id = label_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), firsts AS (
  SELECT part, filter_order, fails, n, good, toxic, nullif(least(CASE WHEN contains(fails, 'A') THEN strpos(filter_order, 'A') ELSE 9 END,
         CASE WHEN contains(fails, 'B') THEN strpos(filter_order, 'B') ELSE 9 END, CASE WHEN contains(fails, 'C') THEN strpos(filter_order, 'C') ELSE 9 END,
         CASE WHEN contains(fails, 'D') THEN strpos(filter_order, 'D') ELSE 9 END, CASE WHEN contains(fails, 'E') THEN strpos(filter_order, 'E') ELSE 9 END), 9) AS first_step
  FROM sets JOIN orders ON true
), steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
         sum(CASE WHEN first_step IS NULL OR first_step > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first_step = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN first_step < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN first_step = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first_step = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM firsts JOIN (SELECT unnest(range(1, 6)) AS step) ON true GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


# Every document's score for every item, from one row per document and term.
OP13_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (
  SELECT doc_id, len(w) AS n FROM doc_terms WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc_terms) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings JOIN totals ON true GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id) JOIN totals ON true GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_html_extraction": op10_html_extraction,
    "op11_url_filters": op11_url_filters,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op11_url_filters": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
