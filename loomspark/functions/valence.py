"""The whole published rule for the valence of short texts, over a lexicon table (token, valence) of any size.

Tokens meet the table in a join: a table below SMALL bytes is broadcast, a larger one meets tokens shuffled with the words around them. Only the
tokens of the table go on, with those words; windows over them in order tell which of the words are in the table, too, and the rule is applied
a row at a time, in built-in functions. No task collects a text's tokens:

* boosters up to three places ahead (of one to three tokens) add to or take from the valence, by 0.95 two and by 0.9 three places ahead;
* negations up to three places ahead turn it (times -0.74), but "without doubt" doesn't, and "never so/this" strengthens it (times 1.25);
* "no" before a token of the lexicon turns that token and counts nothing itself; "least" turns unless "at" or "very" stands before it;
* idioms of two or three tokens replace it;
* capitals count more (0.733) if some tokens are all capitals and some aren't;
* what precedes the first "but" counts half, what follows one and a half times;
* up to four exclamation marks and two or more question marks strengthen the sum.

compound = s / sqrt(s * s + 15) of the sum s. An emoji is a token of its own, for the table to list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lexicons as lex

#: The published constants.
TURN, CAPITALS, DAMPING, NEVER, BUT, NORM = -0.74, 0.733, (1.0, 0.95, 0.9), 1.25, (0.5, 1.5), 15.0
BANG, MOST_BANGS, ASK, MOST_ASKED = 0.292, 4, 0.18, 0.96
IDIOMS = {"the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0}
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Bytes of a lexicon that is broadcast, and the words a token is looked at with: so many places ahead of it, negative ones after it.
SMALL, AROUND = 16 << 20, (-2, -1, 0, 1, 2, 3)


def spaced(text: Column) -> Column:
    """The text with one blank for any white space, and an emoji between blanks; one range that holds all of them is looked at first."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?=[\x{{200D}}-\x{{1FAFF}}])({lex.EMOJI})", " $1 "), r"(?U)\s+", " ")


def bare(part: Column, of: Column) -> Column:
    """The token of a part, or of its lower case: signs at its ends go where more than two characters of `part` stay."""
    kept = F.btrim(part, F.lit(PUNCTUATION))
    return F.when(F.length(kept) > 2, F.when(of == part, kept).otherwise(F.btrim(of, F.lit(PUNCTUATION)))).otherwise(of)


def is_upper(w: Column, low: Column) -> Column:
    return (low != w) & (F.upper(w) == w)


def named(c: str, k: int) -> str:
    return f"{c}{k}".replace("-", "_")


def stress(text: Column) -> Column:
    """What exclamation and question marks add to the sum."""
    mark = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    asks = mark("?")
    return F.least(mark("!"), F.lit(MOST_BANGS)) * BANG + F.when(asks > 3, MOST_ASKED).when(asks > 1, asks * ASK).otherwise(0.0)


def met(rows: DataFrame, key: str, text: str, lexicon: DataFrame, at_most: int = SMALL) -> DataFrame:
    """(key, i, v, n, mixed, force, low.., up..): a row for each token of the lexicon, each "but" and the first token of each text, or one for a text without tokens.

    v is null outside the lexicon; n, mixed and force are the text's. Texts are dealt by key once, and stay there if the lexicon is broadcast.
    A text is put in lower case whole, its signs and blanks don't change by that.
    """
    dealt = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key")
    clean = dealt.select("key", stress(F.col("text")).alias("force"), spaced(F.col("text")).alias("text"))
    parts = lambda c: F.array_remove(F.split(c, " "), "")
    split = clean.select("key", "force", parts(F.col("text")).alias("t"), parts(F.lower("text")).alias("l")).withColumn("ups", F.zip_with("t", "l", is_upper))
    whole = split.select("key", "force", "t", "l", F.size("t").alias("n"), (F.array_contains("ups", True) & F.array_contains("ups", False)).alias("mixed"))
    around = [F.get(c, F.col("i") - k).alias(named(c, k)) for c in ("t", "l") for k in AROUND]
    each = whole.select("*", F.posexplode_outer("t").alias("i", "w")).select("key", "i", "n", "mixed", "force", *around, bare(F.col("w"), F.get("l", F.col("i"))).alias("low"))
    table = lexicon.select(F.lower("token").alias("low"), F.col("valence").alias("v")).dropDuplicates(["low"])
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0))).first()[0]
    found = each.join(F.broadcast(table) if size <= at_most else table, "low", "left")
    kept = found.where(F.col("v").isNotNull() | (F.col("low") == "but") | F.coalesce(F.col("i") == 0, F.lit(True)))
    t, low = (lambda k: F.col(named("t", k))), (lambda k: F.col(named("l", k)))
    lows = [F.coalesce(bare(t(k), low(k)), F.lit("")).alias(named("low", k)) for k in AROUND]
    return kept.select("key", "i", "v", "n", "mixed", "force", *lows, *[F.coalesce(is_upper(t(k), low(k)), F.lit(False)).alias(named("up", k)) for k in AROUND if k >= 0])


def signed(v: Column, by: float | Column) -> Column:
    """v moved away from zero by a positive amount."""
    return v + F.when(v > 0, by).otherwise(-by)


def literal_map(values: Mapping[str, float]) -> Column | None:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else None


def valued(found: DataFrame, boosters: Mapping[str, float], negations: Sequence[str], idioms: Mapping[str, float]) -> DataFrame:
    """The rows of met() with x, the valence of the token by all rules that look around it; 0 outside the lexicon."""
    low, up, plain = (lambda k: F.col(named("low", k))), (lambda k: F.col(named("up", k))), (lambda k: F.col(f"plain{k}"))
    x, mixed, i = F.col("x"), F.col("mixed"), F.col("i")
    one, said, longer = literal_map(boosters), literal_map(idioms), literal_map({k: b for k, b in boosters.items() if " " in k})
    boost = lambda k: F.lit(0.0) if one is None else F.coalesce(F.try_element_at(one, low(k)), F.lit(0.0))
    held = lambda table, *ks: F.try_element_at(table, F.concat_ws(" ", *[low(k) for k in ks]))
    idiom = lambda *ks: held(said, *ks)

    rows = found.withColumn("hit", F.when(F.col("v").isNotNull(), i))
    order, text = Window.partitionBy("key").orderBy("i"), Window.partitionBy("key")
    rows = rows.select("*", *[F.lag("hit", j).over(order).alias(f"hit{j}") for j in (1, 2, 3)], F.lead("hit").over(order).alias("hit_1"), F.min(F.when(low(0) == "but", i)).over(text).alias("but"))
    listed = lambda k: reduce(Column.__or__, [F.coalesce(F.col(f"hit{j}") == i - k, F.lit(False)) for j in range(1, k + 1)])
    rows = rows.withColumns({f"plain{k}": (i >= k) & ~listed(k) for k in (1, 2, 3)})

    before = (low(1) == "no") | (low(2) == "no") | ((low(3) == "no") & low(1).isin("or", "nor"))
    rows = rows.withColumn("x", F.when((low(0) == "no") & F.coalesce(F.col("hit_1") == i + 1, F.lit(False)), 0.0).when(before, F.col("v") * TURN).otherwise(F.col("v")))
    rows = rows.withColumn("x", F.when(up(0) & mixed, signed(x, CAPITALS)).otherwise(x))
    for k in (1, 2, 3):
        rows = rows.withColumn("b", boost(k)).withColumn("b", F.when(x < 0, -F.col("b")).otherwise(F.col("b")))
        more = F.when(F.col("b") == 0, 0.0).when(up(k) & mixed, F.col("b") + F.when(x > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(F.col("b"))
        rows = rows.withColumn("y", x + more * DAMPING[k - 1])
        nearer = [low(j) for j in range(1, k)]
        strong = (low(k) == "never") & reduce(Column.__or__, [n.isin("so", "this") for n in nearer], F.lit(False))
        sure = (low(k) == "without") & reduce(Column.__or__, [n == "doubt" for n in nearer], F.lit(False))
        negated = low(k).isin(*negations) | low(k).contains("n't")
        turned = F.when(strong, F.col("y") * NEVER).when(sure, F.col("y")).when(negated, F.col("y") * TURN).otherwise(F.col("y"))
        if k == 3 and idioms:
            after = F.coalesce(idiom(0, -1, -2), idiom(0, -1))
            turned = F.coalesce(after, idiom(1, 0), idiom(2, 1, 0), idiom(2, 1), idiom(3, 2, 1), idiom(3, 2), turned)
        if k == 3 and longer is not None:  # boosters of two and three tokens
            turned = turned + reduce(Column.__add__, [F.coalesce(held(longer, *ks), F.lit(0.0)) for ks in ((3, 2, 1), (3, 2), (2, 1))])
        rows = rows.withColumn("x", F.when(plain(k), turned).otherwise(x))
    least = (low(1) == "least") & plain(1) & ~low(2).isin("at", "very")
    counts = F.col("v").isNotNull() & (boost(0) == 0) & ~((low(0) == "kind") & (low(-1) == "of"))
    part = F.when(F.col("but").isNull() | (i == F.col("but")), 1.0).when(i < F.col("but"), BUT[0]).otherwise(BUT[1])
    return rows.withColumn("x", F.when(least, x * TURN).otherwise(x)).select("key", "n", "force", (F.when(counts, x).otherwise(0.0) * part).alias("x"))


def scored(rows: DataFrame, key: str, text: str, lexicon: DataFrame, boosters: Mapping[str, float] = lex.BOOSTERS, negations: Sequence[str] = lex.NEGATIONS, idioms: Mapping[str, float] = IDIOMS, at_most: int = SMALL) -> DataFrame:
    """rows with compound (four digits), pos, neu and neg (three digits each); `key` tells the rows apart.

    Null and blank texts score 0. Of a token listed twice in the lexicon one entry counts. A lexicon of at most `at_most` bytes is broadcast.
    """
    x, s, force = F.col("x"), F.col("s"), F.col("force")
    each = valued(met(rows, key, text, lexicon, at_most), boosters, negations, idioms)
    sums = each.groupBy("key").agg(F.sum("x").alias("s"), F.sum(F.when(x > 0, x + 1).otherwise(0.0)).alias("up"), F.sum(F.when(x < 0, x - 1).otherwise(0.0)).alias("down"), (F.max("n") - F.count(F.when(x != 0, 1))).alias("none"), F.max("force").alias("force"))
    total = sums.withColumn("s", s + F.signum(s) * force).withColumns({"more": F.when(F.col("up") > -F.col("down"), force).otherwise(0.0), "less": F.when(F.col("up") < -F.col("down"), force).otherwise(0.0)})
    total = total.withColumns({"up": F.col("up") + F.col("more"), "down": -F.col("down") + F.col("less")}).withColumn("mass", F.nullif(F.col("up") + F.col("down") + F.col("none"), F.lit(0.0)))
    share = lambda v: F.round(F.col(v) / F.col("mass"), 3)
    scores = {"compound": F.round(s / F.sqrt(s * s + NORM), 4), "pos": share("up"), "neu": share("none"), "neg": share("down")}
    known = total.select(F.col("key").alias(key), *[c.alias(f"__{n}") for n, c in scores.items()])
    fields = [F.coalesce(f"__{n}", F.lit(0.0)).alias(n) for n in scores]
    return rows.join(known, key, "left").select(*[F.col(f"`{c}`") for c in rows.columns if c not in scores], *fields)
