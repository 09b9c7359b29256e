"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Only DataFrame functions touch the rows. Base spans (email, ip, card, phone) are the leftmost non-overlapping matches
of their patterns that pass a check; all of them stay. Further candidates are loose spans: long hexadecimal runs
(``secret``), digit runs that are no valid card (``number``), addresses without a dotted host (``mailish``), dotted
numbers that are no address (``dotted``). Regex, gazetteer and context labelers vote on every candidate; EM estimates
the labelers' reliabilities from the counted vote patterns, and a logistic classifier over kind and votes, trained
on the posteriors, adds the candidates it finds personal. The counted patterns are at most kinds x 3 ** labelers.

Positions are code points, end exclusive. Null texts are empty. An added span that overlaps a base span is dropped.
Repeated rows give repeated results, an empty table an empty result; extra columns pass through. A text of very many
matches takes n ** 1.5 steps on integers for n of them (``running``), and no array that grows match by match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak_labels
from .common import fresh_name
from .weak_labels import choice, sigmoid, vote

# Fixed values of the contract, written for linear time: possessive runs cannot give characters back that would
# help, and a match of email or ip can only start where its first run starts (or where the last match ended).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
# Loose candidates.
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
MAILISH = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-]|[A-Za-z0-9-])"
#: Shorter digit runs are neither a card nor a candidate.
LEAST_DIGITS = 9
KINDS = (*BASE, "secret", "number", "mailish", "dotted")

# Zeros run possessively; a part of zeros only ends right after one.
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"
ADDRESS = rf"^{PART}(?:\.{PART}){{3}}$"
# Gazetteers: top-level names, calling codes, first digits of card issuers, reserved first parts.
HOSTS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|at|ch|uk|us|ca|au|jp|br|in|ru|pl)$"
CALLING = r"^\+(?:1|7|2[07]|3[0-4690]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUER = r"^(?:3[47068]|4|5[1-5]|2[2-7]|6)"
RESERVED = r"^0*+(?:(?<=0)|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
# Context words before a span.
NEAR = r"(?i)(?:token|secret|passw(?:or)?d|api.?key|key|tel|phone|telefon|t[eé]l[eé]phone|tel[eé]fono|call|fax|mobile|e-?mail|mail|correo|courriel|contact|kontakt|contacto|card|visa|karte|carte|tarjeta|ip|host|server)\W{0,4}$"
FAR = r"(?i)(?:version|v|isbn|doi|page|seite|section|chapter|no|nr)[.:\s]{0,3}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: inside a lambda an outer expression would be again at every call."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Fold of all values before each one. Blocks of about the square root of their number are folded first, then the blocks before a
    block and the values before a value in it, so n values take n ** 1.5 steps on integers and no array grows step by step."""
    whole = lambda xs: F.aggregate(xs, zero, fold)
    before = lambda xs, k: whole(F.slice(xs, F.lit(1), k))
    wide = lambda v: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
    cut = lambda v: let(wide(v), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda j: F.slice(v, j * w + 1, w)))

    def folded(blocks: Column, sums: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, j: let(before(sums, j), lambda base: F.transform(b, lambda _, k: fold(base, before(b, k))))))

    some = lambda v: let(cut(v), lambda blocks: let(F.transform(blocks, whole), lambda sums: folded(blocks, sums)))
    return let(values, lambda v: F.when(F.size(v) > 0, some(v)).otherwise(v))


def spans_of(text: Column, pattern: str, kind: str, least: int = 1) -> Column:
    """Array of (kind, start, end, match, before, after) of the leftmost non-overlapping matches of at least ``least`` characters.

    Splitting at the matches gives the texts between them, whose lengths give the positions.
    """

    def span(p: Column) -> Column:
        begin = p["at"] + F.length(p["b"])
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(p["m"])).alias("end"), p["m"].alias("match"),
                        F.right(p["b"], F.lit(24)).alias("before"), F.left(p["n"], F.lit(1)).alias("after"))

    def placed(found: Column, between: Column) -> Column:
        n = F.size(found)
        steps = F.zip_with(F.slice(between, F.lit(1), n), found, lambda b, m: F.length(b) + F.length(m))
        parts = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), n).alias("b"), F.slice(between, F.lit(2), n).alias("n"), running(steps, lambda x, y: x + y, F.lit(0)).alias("at"))
        return F.transform(F.filter(parts, lambda p: F.length(p["m"]) >= least), span)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda between: placed(f, between))).otherwise(none))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    from_right = F.reverse(digits(match))
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substr(from_right, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(from_right)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def valid(s: Column) -> Column:
    """The contract's check of a base match."""
    n = F.length(digits(s["match"]))
    return (F.when(s["kind"] == "email", True).when(s["kind"] == "ip", s["match"].rlike(ADDRESS))
            .when(s["kind"] == "card", n.between(13, 19) & luhn(s["match"])).when(s["kind"] == "phone", n.between(9, 15)).otherwise(False))


def candidates(text: Column) -> tuple[Column, Column]:
    """(base matches that pass their check, loose candidates) of a text that is not null."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>")
    has_digit, has_at = text.rlike("[0-9]"), text.contains("@")
    some = lambda cond, col: F.when(cond, col).otherwise(empty)
    matches = F.concat(some(has_at, spans_of(text, EMAIL, "email")), some(has_digit, spans_of(text, IP, "ip")),
                       some(has_digit, spans_of(text, CARD, "card", LEAST_DIGITS)), some(text.contains("+"), spans_of(text, PHONE, "phone")))
    loose = F.concat(some(has_digit, spans_of(text, SECRET, "secret")), some(has_at, spans_of(text, MAILISH, "mailish")))
    return matches, loose


def renamed(s: Column, kind: Column) -> Column:
    return F.struct(kind.alias("kind"), *[s[k].alias(k) for k in ("start", "end", "match", "before", "after")])


#: Labelers: votes on a candidate struct.
LABELERS = {
    "shape": lambda s: vote(s["kind"].isin("mailish", "dotted"), s["kind"].isin(*BASE, "secret")),
    "checksum": lambda s: vote((s["kind"] == "number") & F.length(digits(s["match"])).between(13, 19), s["kind"] == "card"),
    "gazetteer": lambda s: vote(s["kind"].isin("ip", "dotted") & s["match"].rlike(RESERVED),
                                ((s["kind"] == "email") & s["match"].rlike(HOSTS)) | ((s["kind"] == "phone") & s["match"].rlike(CALLING)) | (s["kind"].isin("card", "number") & digits(s["match"]).rlike(ISSUER))),
    "context": lambda s: vote(s["before"].rlike(FAR), s["before"].rlike(NEAR)),
    "boundary": lambda s: vote(s["before"].rlike(r"[\p{L}\p{N}]$") | s["after"].rlike(r"^[\p{L}\p{N}]"), (s["before"] == "") | s["before"].rlike(r"""[\s"'(<=:]$""")),
    "variety": lambda s: vote(s["match"].rlike(r"^(.)\1+$") | s["match"].rlike("(?:0123456|1234567|0000000)"), F.length(s["match"]) >= 7),
}


def found(docs: DataFrame, text_col: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` with struct ``into``: ``base`` spans, ``loose`` candidates."""
    into = into or fresh_name(docs, "found")
    text, raw = fresh_name(docs, "_t"), fresh_name(docs, "_raw")
    matches, loose = candidates(F.col(text))
    out = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = out.withColumn(raw, F.struct(matches.alias("m"), loose.alias("l")))
    out = out.withColumn(raw, F.struct(F.transform(F.col(raw)["m"], lambda s: F.struct(s.alias("s"), valid(s).alias("ok"))).alias("m"), F.col(raw)["l"].alias("l")))
    base = F.transform(F.filter(F.col(raw)["m"], lambda x: x["ok"]), lambda x: x["s"])
    failed = F.transform(F.filter(F.col(raw)["m"], lambda x: ~x["ok"] & (x["s"]["kind"].isin("ip") | (F.length(digits(x["s"]["match"])) >= LEAST_DIGITS))),
                         lambda x: renamed(x["s"], F.when(x["s"]["kind"] == "ip", "dotted").otherwise("number")))
    made = F.struct(base.alias("base"), F.concat(failed, F.col(raw)["l"]).alias("loose"))
    return out.withColumn(into, made).select(*[F.col(f"`{c}`") for c in docs.columns], into)


class Model:
    """Labeler reliabilities and the final classifier."""

    def __init__(self, prior, odds, bias, kinds, votes):
        self.prior, self.odds, self.bias, self.kinds, self.votes = prior, odds, bias, kinds, votes

    def score(self, s: Column) -> Column:
        total = F.lit(self.bias) + choice(s["kind"], self.kinds)
        for rule, weights in zip(LABELERS.values(), self.votes, strict=True):
            total = total + choice(rule(s), weights)
        return 1 / (1 + F.exp(-total))


def fit(spotted: DataFrame, into: str, *, rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> Model:
    """Reliabilities by EM and the classifier by gradient steps, both on the counted patterns of all rows."""
    names = [f"v{k}" for k in range(len(LABELERS))]
    spans = spotted.select(F.explode(F.concat(F.col(into)["base"], F.col(into)["loose"])).alias("s"))
    votes = spans.select(F.col("s.kind").alias("kind"), *[rule(F.col("s")).alias(n) for n, rule in zip(names, LABELERS.values(), strict=True)])
    rows = sorted((r["kind"], tuple(r[n] for n in names), r["rows"]) for r in votes.groupBy("kind", *names).agg(F.count("*").alias("rows")).collect())
    counts: dict[tuple, int] = {}
    for _, pattern, n in rows:
        counts[pattern] = counts.get(pattern, 0) + n
    prior, odds = weak_labels.fit(sorted(counts.items()), len(LABELERS))
    target = {p: weak_labels.posterior(prior, odds, p) for p in counts}
    bias, kinds, weights = 0.0, dict.fromkeys(KINDS, 0.0), [dict.fromkeys(weak_labels.VOTES, 0.0) for _ in names]
    total = sum(n for *_, n in rows)
    for _ in range(rounds if total else 0):
        step = [(k, p, n / total * (target[p] - sigmoid(bias + kinds[k] + sum(w[v] for w, v in zip(weights, p, strict=True))))) for k, p, n in rows]
        bias += rate * sum(g for *_, g in step)
        for table in (kinds, *weights):
            for key in table:
                table[key] *= 1 - rate * decay
        for k, p, g in step:
            kinds[k] += rate * g
            for w, v in zip(weights, p, strict=True):
                w[v] += rate * g
    if not total:
        bias, weights = -1.0, [{v: float(v) for v in weak_labels.VOTES} for _ in names]
    return Model(prior, odds, bias, kinds, weights)


def detect(docs: DataFrame, text_col: str = "text", *, into: str | None = None, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """``docs`` with struct ``into``: ``base`` and ``spans`` (kind, start, end), in the order of kinds, then start."""
    into = into or fresh_name(docs, "pii")
    spotted = found(docs, text_col, into)
    model = model or fit(spotted, into)
    base, loose = F.col(into)["base"], F.col(into)["loose"]
    added = apart(F.filter(loose, lambda s: model.score(s) >= threshold), base)
    of_kind = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    order = lambda spans: F.concat(*[of_kind(spans, kind) for kind in KINDS])
    plain = lambda spans: F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in ("kind", "start", "end")]))
    made = F.struct(plain(base).alias("base"), plain(order(F.concat(base, added))).alias("spans"))
    return spotted.withColumn(into, made)


def later(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def apart(spans: Column, base: Column) -> Column:
    """``spans`` that overlap none of ``base``: both in one order by start, the last end of a base span before and the first start of one after
    decide."""
    row = lambda s, is_base: F.struct(s["start"].alias("start"), F.lit(int(not is_base)).alias("added"), s["end"].alias("end"), s.alias("s"))
    far = F.lit(2**31 - 1)

    def clear(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["added"] == 0, x["end"]).otherwise(0)), later, F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["added"] == 0, x["start"]).otherwise(far))), lambda x, y: F.least(x, y), far))
        kept = F.filter(F.arrays_zip(both.alias("x"), ends.alias("e"), starts.alias("n")), lambda p: (p["x"]["added"] == 1) & (p["e"] <= p["x"]["start"]) & (p["n"] >= p["x"]["end"]))
        return F.transform(kept, lambda p: p["x"]["s"])

    def apart_from(some: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(base, lambda s: row(s, True)), F.transform(some, lambda s: row(s, False))))
        return F.when((F.size(some) == 0) | (F.size(base) == 0), some).otherwise(let(both, clear))

    return let(spans, apart_from)


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""

    def piece(p: Column) -> Column:
        at, s = p["at"], p["s"]
        kept = F.substr(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.concat(kept, F.when(s["start"] >= at, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))

    def marked(ordered: Column) -> Column:
        done = running(F.transform(ordered, lambda s: s["end"]), later, F.lit(0))
        pieces = F.array_join(F.transform(F.arrays_zip(ordered.alias("s"), done.alias("at")), piece), "")
        last = F.array_max(F.transform(ordered, lambda s: s["end"]))
        return F.concat(pieces, F.substr(text, last + 1, F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, let(ordered, marked)).otherwise(text)
