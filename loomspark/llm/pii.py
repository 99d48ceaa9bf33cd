"""Personal data by weak supervision, in built-in functions only.

Candidates of five kinds come from regular expressions. Four labelers vote on each one (1 yes,
0 no, 2 abstain): the regex labeler on its shape, the validity labeler on its check (octets,
Luhn, digit count), the gazetteer labeler on listed words or prefixes, the context labeler on what
stands around it. Expectation-maximisation over the counts of all vote patterns estimates each
kind's prior and each labeler's reliability; the posteriors then train a logistic span classifier
on votes, kind, length and digit share. Both read only a table of pattern counts, whose size is
bounded by the patterns there can be, not by the rows.

Base spans (email, ip, card, phone that pass their checks) are always kept; the classifier decides
on the other candidates: secrets and phone numbers without a plus sign. A candidate that overlaps
a base span is dropped.

The patterns match what the plain ones do; possessive quantifiers and the look-behind only spare
the regex engine retries, so long runs stay linear.

Defined results: null text is the empty text, without spans. Repeated rows are labelled one by
one. Texts are taken whole. With no candidate at all the model accepts nothing beyond the base.
Other columns pass through; those named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "example")
CARD_PREFIXES = "^(4|5[1-5]|2[2-7]|3[47]|6(011|5))"
SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|api[ _-]?key|access[ _-]?key|bearer|credential)[^\n]{0,16}$"
PHONE_WORDS = r"(?i)(phone|tel|call|mobile|cell|fax|t[ée]l[ée]fono?|telefon|anruf)[^\n]{0,16}$"
MAIL_WORDS = r"(?i)(mail|contact|kontakt|write|mailto|correo|courriel)[^\n]{0,16}$"
CARD_WORDS = r"(?i)(card|visa|credit|carte|karte|tarjeta|payment)[^\n]{0,16}$"
IP_WORDS = r"(?i)(ip|host|server|address|adresse|from)[^\n]{0,16}$"
BEFORE, AFTER = 24, 8
SPAN = "struct<s:int,e:int,t:string,before:string,after:string>"


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def octets(t: Column) -> Column:
    return F.forall(F.transform(F.split(t, "[.]"), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, x).cast("int") <= 255))


def card_number(t: Column) -> Column:
    d = digits(t)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def phone_number(t: Column) -> Column:
    return F.length(digits(t)).between(10, 15)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


@dataclass(frozen=True)
class Source:
    """A candidate pattern with its labelers. base: matches that pass `valid` are base spans."""

    kind: str
    pattern: str
    gate: Callable[[Column], Column]
    base: bool
    valid: Callable[[Column], Column]
    shape: Callable[[Column], Column]
    gazetteer: Callable[[Column], Column]
    context: Callable[[Column], Column]


def bare(x: Column) -> Column:
    """The candidate stands alone, not inside a longer word or number."""
    return vote(~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z0-9]"), x["before"].rlike("[A-Za-z0-9]$"))


def near(x: Column, words: str) -> Column:
    return F.when(x["before"].rlike(words), 1).otherwise(2)


#: The patterns.
SOURCES = (
    Source(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), True,
        lambda x: F.lit(True),
        lambda x: vote(x["t"].rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@"), x["t"].rlike(r"\.\.|^[.]")),
        lambda x: F.when(F.lower(F.substring_index(x["t"], ".", -1)).isin(*TOP_DOMAINS), 1).otherwise(near(x, MAIL_WORDS)),
        bare,
    ),
    Source(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), True,
        lambda x: octets(x["t"]),
        lambda x: vote(x["t"].rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), x["t"].rlike("[0-9]{4}")),
        lambda x: near(x, IP_WORDS),
        lambda x: F.when(x["after"].rlike(r"^\.[0-9]") | x["before"].rlike(r"[0-9]\.$"), 0).otherwise(bare(x)),
    ),
    Source(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), True,
        lambda x: card_number(x["t"]),
        lambda x: vote(F.length(digits(x["t"])).between(14, 19), F.length(digits(x["t"])) < 13),
        lambda x: F.when(digits(x["t"]).rlike(CARD_PREFIXES), 1).otherwise(near(x, CARD_WORDS)),
        bare,
    ),
    Source(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), True,
        lambda x: phone_number(x["t"]),
        lambda x: vote(x["t"].rlike(r"^\+[0-9]{1,3}[ .(-]"), x["t"].rlike(r"[ .()-]{4}")),
        lambda x: near(x, PHONE_WORDS),
        bare,
    ),
    Source(
        "phone", r"(?<![0-9A-Za-z+.)-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"), False,
        lambda x: phone_number(x["t"]),
        lambda x: vote(x["t"].rlike(r"^\([0-9]{3}\) ") | x["t"].rlike(r"^[2-9][0-9]{2}-[0-9]{3}-"), x["t"].rlike(r"^\(?[01]")),
        lambda x: near(x, PHONE_WORDS),
        lambda x: F.when(x["before"].rlike(r"[0-9][ .-]?$") | x["after"].rlike(r"^[ .-]?[0-9]"), 0).otherwise(bare(x)),
    ),
    Source(
        "secret", r"(?<![A-Za-z0-9_+/@.-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+(?![@.][A-Za-z0-9])", lambda t: t.rlike("[0-9]"), False,
        lambda x: F.length(digits(x["t"])) >= 4,
        lambda x: vote(x["t"].rlike("^([0-9a-f]{24,}|[0-9A-F]{24,}|[A-Za-z]{2,6}_[A-Za-z0-9]{16,})$"), F.length(digits(x["t"])) < 4),
        lambda x: near(x, SECRET_WORDS),
        lambda x: vote(x["before"].rlike("[=:] ?[\"']?$"), x["before"].rlike("[A-Za-z,] $")),
    ),
)


def matches(text: Column, source: Source) -> Column:
    """Non-overlapping matches with code-point positions and their surroundings."""
    m, p = F.regexp_extract_all(text, F.lit(source.pattern), F.lit(0)), F.split(text, source.pattern, -1)
    zipped = F.transform(m, lambda x, i: F.struct(x.alias("t"), F.get(p, i).alias("p"), F.left(F.get(p, i + 1), F.lit(AFTER)).alias("after")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"), F.right(x["p"], F.lit(BEFORE)).alias("before"), x["after"].alias("after"))).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(source.gate(text), F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with __c: array of candidates (kind, s, e, base, votes, size, share)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({f"__m{i}": matches(raw, s) for i, s in enumerate(SOURCES)})

    def voted(x: Column, s: Source) -> Column:
        valid = F.coalesce(s.valid(x), F.lit(False))
        size = F.least(F.lit(3), (F.length(x["t"]) / 10).cast("int"))
        share = (3 * F.length(digits(x["t"])) / F.length(x["t"])).cast("int")
        return F.struct(
            F.lit(s.kind).alias("kind"), F.lit(KINDS.index(s.kind)).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), (valid & F.lit(s.base)).alias("base"), F.lit(not s.base).alias("extra"),
            s.shape(x).alias("v0"), F.when(valid, 1).otherwise(0).alias("v1"), s.gazetteer(x).alias("v2"), s.context(x).alias("v3"), size.alias("size"), share.alias("share"),
        )

    def each(s: Source) -> Callable[[Column], Column]:
        return lambda x: voted(x, s)

    found = [F.transform(f"__m{i}", each(s)) for i, s in enumerate(SOURCES)]
    return df.withColumn("__c", F.concat(*found)).drop(*[f"__m{i}" for i in range(len(SOURCES))])


FEATURES = [("kind", k) for k in KINDS] + [(f"v{i}", v) for i in range(4) for v in (0, 1)] + [("size", v) for v in range(4)] + [("share", v) for v in range(4)]


@dataclass(frozen=True)
class SpanModel:
    """Priors by kind, (sensitivity, specificity) by labeler, weights of the final classifier."""

    priors: dict[str, float]
    reliability: tuple[tuple[float, float], ...]
    weights: tuple[float, ...]

    def accepts(self, x: Column) -> Column:
        terms = [F.when(x[name] == value, w).otherwise(0.0) for (name, value), w in zip(FEATURES, self.weights[1:], strict=True)]
        return reduce(Column.__add__, terms, F.lit(self.weights[0])) >= 0.0


def fit(docs: DataFrame, text: str = "text", rounds: int = 60) -> SpanModel:
    """EM over the vote patterns of all rows, then the classifier on its posteriors."""
    names = ["kind", "v0", "v1", "v2", "v3", "size", "share"]
    seen = candidates(docs.select(text), text).select(F.explode("__c").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).count()
    rows = sorted((tuple(r) for r in seen.collect()), key=str)
    return SpanModel(*em(rows, rounds))


def em(rows: list[tuple], rounds: int) -> tuple[dict[str, float], tuple, tuple[float, ...]]:
    """rows: (kind, four votes, size, share, count). Starts from the majority of votes."""
    post = [min(0.95, max(0.05, (1 + sum(v == 1 for v in r[1:5])) / (2 + sum(v != 2 for v in r[1:5])))) for r in rows]
    priors, trust = {}, ()
    for _ in range(rounds):
        for kind in {r[0] for r in rows}:
            mine = [(r[-1], p) for r, p in zip(rows, post, strict=True) if r[0] == kind]
            priors[kind] = (1 + sum(n * p for n, p in mine)) / (2 + sum(n for n, _ in mine))
        found = []
        for i in range(1, 5):
            voted = [(r[i], r[-1], p) for r, p in zip(rows, post, strict=True) if r[i] != 2]
            hit = (4 + sum(n * p for v, n, p in voted if v == 1)) / (5 + sum(n * p for _, n, p in voted))
            miss = (4 + sum(n * (1 - p) for v, n, p in voted if v == 0)) / (5 + sum(n * (1 - p) for _, n, p in voted))
            found.append((max(hit, 0.55), max(miss, 0.55)))
        trust = tuple(found)
        for k, r in enumerate(rows):
            odds = math.log(priors[r[0]] / (1 - priors[r[0]]))
            for v, (hit, miss) in zip(r[1:5], trust, strict=True):
                odds += 0 if v == 2 else math.log(hit / (1 - miss)) if v == 1 else math.log((1 - hit) / miss)
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return priors, trust, classifier(rows, post)


def classifier(rows: list[tuple], post: list[float], steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression on the posteriors, each pattern weighted by the log of its count."""
    at = {"kind": 0, "v0": 1, "v1": 2, "v2": 3, "v3": 4, "size": 5, "share": 6}
    x = [[0] + [j + 1 for j, (name, value) in enumerate(FEATURES) if r[at[name]] == value] for r in rows]
    mass = [math.log1p(r[-1]) for r in rows]
    w, total = [0.0] * (len(FEATURES) + 1), sum(mass) or 1.0
    w[0] = -1e-9
    for _ in range(steps):
        slope = [ridge * v for v in w]
        for on, p, m in zip(x, post, mass, strict=True):
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[j] for j in on)))))
            for j in on:
                slope[j] += m * (guess - p) / total
        w = [v - rate * s for v, s in zip(w, slope, strict=True)]
    return tuple(w)


def label(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """docs with pii: array of (start, rank, end, kind, base), ordered by start and kind."""
    c = candidates(docs.drop("pii"), text)
    base = c.withColumn("__b", F.filter("__c", lambda x: x["base"]))
    extra = F.filter("__c", lambda x: x["extra"] & model.accepts(x) & ~F.exists("__b", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    shape = lambda x: F.struct(x["s"].alias("start"), x["rank"].alias("rank"), x["e"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))
    return base.withColumn("pii", F.array_sort(F.transform(F.concat("__b", extra), shape))).drop("__c", "__b")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    raw = F.col(text)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(raw, acc["at"] + 1, x["start"] - acc["at"])
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(raw, acc["at"] + 1, F.length(raw))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(raw))
