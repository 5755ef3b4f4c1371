"""URL filters: fixed host-and-path rules, then association rules mined from labelled URLs.

URLs become sets of tokens (host labels and their parts, suffixes of the host, path parts, query
keys).  FP-growth mines sets of up to three tokens that occur with a blocking label; rules of enough support and
confidence are kept, and a rule that contains another kept rule is redundant.  Each rule is filed under
its rarest token (an inverted index), so a URL meets only rules whose rarest token it holds, and then
has to hold the others.

DataFrame operations and Spark's own FP-growth only.  Equal URLs get equal verdicts, so mined verdicts
are made once per distinct URL.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is
allowed; without labelled URLs of both kinds nothing is mined; repeated rows count each and are judged
alike; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._shared import Tables, small_side
from sensorweave.llm.decontaminate import LOWER, UPPER

BLOCKED = "verdict=block"
ALLOWED = "verdict=allow"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
#: Items of a row from which on it is mined as its pairs and triples.
LONG = 10


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that every filter applies first.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z in lower case) and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(u, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def longest_rule(rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later, longer rules stand outside
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """The distinct tokens of a URL whose ``host`` and ``path`` are known."""
    labels = F.split("host", r"\.")
    parts = F.filter(F.split(F.translate("path", UPPER, LOWER), "/"), lambda p: p != "")
    query = F.regexp_extract_all(F.coalesce(F.col(url), F.lit("")), F.lit(r"[?&]([A-Za-z_]+)="), F.lit(1))
    found = F.concat(
        F.transform(F.slice(labels, 1, F.size(labels) - 1), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("word:"), x)),
        F.array(F.concat(F.lit("top:"), F.element_at(labels, -1))),
        # runs of digits in a path are one token, whatever the number
        F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.lower(x))),
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def _up_to(items: Column, size: int) -> Column:
    """Baskets in which FP-growth meets each set of ``size`` items of the row once: the row itself, or all such sets of a long row."""
    pairs = F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.array(x, y))))
    sets = pairs
    if size == 3:
        sets = F.flatten(F.transform(items, lambda x, i: F.flatten(F.transform(F.slice(items, i + 2, F.size(items)), lambda y, j: F.transform(F.slice(items, i + j + 3, F.size(items)), lambda z: F.array(x, y, z))))))
    return F.when(F.size(items) <= LONG, F.array(items)).otherwise(sets)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, tables: Tables | None = None) -> DataFrame:
    """Blocking rules (antecedent, token, confidence, support) of up to three tokens from rows of ``tokens`` and ``verdict``.

    ``token`` is the rarest of the antecedent, under which the rule is filed.  Rules of one token are
    counted first.  Their tokens, and those too rare among blocked rows, cannot be in another rule that
    says something new, so FP-growth gets the others; tokens that stand in the same rows (two sums over
    the rows' hashes tell) are one item to it, as one of them says what all do.  Rows of more than ``LONG`` items are
    given as their pairs and triples, so no row costs more than the cube of its length.
    """
    tables = tables or Tables(labelled.sparkSession, "url-rules")
    rows = tables.add(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", (F.col("verdict") == "block").alias("blocked")))
    n = rows.count()
    least = math.ceil(min_support * n)
    mark = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    counted = tables.add(rows.select("row", "blocked", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"), *mark).where(F.col("hits") >= max(least, 1)))
    confidence = F.col("hits") / F.col("n")
    single = counted.where(confidence >= min_confidence).select(F.array("token").alias("antecedent"), "token", confidence.alias("confidence"), (F.col("hits") / n).alias("support"))
    alike = tables.add(counted.where(confidence < min_confidence).groupBy("n", "hits", "h1", "h2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select("item", "tokens"))
    # of blocked and allowed rows alike, as sets of items; rows of fewer than two items make no further rule
    items = small_side(alike.select(F.col("item").alias("token"), F.col("item")))
    short = rows.select("row", "blocked", F.explode("tokens").alias("token")).join(items, "token").groupBy("row", "blocked").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    verdict = F.when(F.col("blocked"), BLOCKED).otherwise(ALLOWED)
    tagged = [short.select(verdict.alias("verdict"), F.explode(_up_to(F.col("items"), k)).alias("set"), F.lit(f"{k}|").alias("tag")) for k in (2, 3)]
    baskets = tables.add(tagged[0].unionByName(tagged[1]).select(F.concat(F.transform("set", lambda x: F.concat("tag", x)), F.array("verdict")).alias("items")))
    of = baskets.count()
    if not of:
        return single
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least - 0.5, 0.5) / of), minConfidence=min_confidence).fit(baskets)
    size = F.size("antecedent")
    found = model.associationRules.where((F.element_at("consequent", 1) == BLOCKED) & (size > 1) & ~F.array_contains("antecedent", ALLOWED) & F.forall("antecedent", lambda x: F.startswith(x, F.concat(size.cast("string"), F.lit("|")))))
    rules = tables.add(found.select(F.array_sort(F.transform("antecedent", lambda x: F.substring(x, 3, 1_000_000))).alias("antecedent"), "confidence", (F.col("support") * of / n).alias("support")))
    # a rule of three whose pairs hold a rule says nothing more
    part = rules.where(size == 3).select("antecedent", F.explode("antecedent").alias("left_out")).select("antecedent", F.array_remove("antecedent", F.col("left_out")).alias("part"))
    redundant = part.join(rules.select(F.col("antecedent").alias("part")), "part", "left_semi").select("antecedent").distinct()
    kept = rules.join(redundant, "antecedent", "left_anti").select("antecedent", "confidence", "support", F.posexplode("antecedent").alias("at", "item"))
    # each item stands for the tokens alike: a rule for each choice of them
    chosen = kept.join(alike, "item").groupBy("antecedent", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("parts"))
    every = F.aggregate("parts", F.array(F.array().cast("array<string>")), lambda acc, p: F.flatten(F.transform(acc, lambda s: F.transform(p["tokens"], lambda t: F.array_append(s, t)))))
    spelled = chosen.select("confidence", "support", F.explode(every).alias("antecedent")).withColumn("antecedent", F.array_sort("antecedent"))
    filed = spelled.select("*", F.explode("antecedent").alias("token")).join(counted.select("token", "n"), "token")
    filed = filed.groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return single.unionByName(filed)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """Per row: key, host, path, rule, verdict (the rule's; else block where a mined rule fits; else allow).

    The URLs that a fixed rule judges are the labels that rules are mined from.
    """
    name, verdict = longest_rule(rules)
    rows = with_parts(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url").withColumn("rule", name).withColumn("_given", verdict)
    labelled = rows.where("_given is not null").select(tokens("_url").alias("tokens"), F.col("_given").alias("verdict"))
    tables = Tables(pages.sparkSession, "url-rules")
    mined = tables.add(mine(labelled, tables=tables))
    urls = rows.where("_given is null and host != ''").select("_url", tokens("_url").alias("tokens")).distinct()
    met = urls.select("_url", "tokens", F.explode("tokens").alias("token")).join(small_side(mined), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    blocked = tables.add(met.groupBy("_url").agg(F.max("confidence").alias("_confidence")))
    found = rows.join(small_side(blocked), "_url", "left")
    return found.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_given", F.when(F.col("_confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.coalesce("_confidence", F.lit(0.0)).alias("mined_confidence"))
