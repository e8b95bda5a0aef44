"""URL filters: host and path rules, and for the rest a ratio of character language models learned from what rules judge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargofile.llm.common import cut, hot_join, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
FLOOR = 1 / 256
# Grams up to which the score table may be broadcast (about 100 bytes each).
BROADCAST_GRAMS = 200_000
# Calibration looks at this many steps of the score at most.
STEP, REACH = 0.002, 20.0


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    UrlRule("com", "/en/", "block"), UrlRule("example.com", "/en/7", "allow"), UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"), UrlRule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty for null or without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host or subdomain and path start fit; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(url: Column, order: int) -> Column:
    """Every character with the `order` before it, the end included; starts are filled up."""
    filled = F.concat(F.lit("\x02" * order), url, F.lit("\x03"))
    return F.regexp_extract_all(filled, F.lit("(?s)(?=(.{%d}))" % (order + 1)), F.lit(1))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, often, ratio) from counts (gram, often, yes, no): log P_yes - log P_no of its last character.

    Both models interpolate all context lengths from 0 to `order` by Witten and Bell: a context seen N times before T
    different characters gives the shorter context the weight T / (N + T); one never seen leaves it all. Level by
    level, each table is joined with the one a character shorter.
    """
    lower = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(
            F.sum("often").alias("often"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        same = Window.partitionBy(F.substring("gram", 1, k) if k else F.lit(0))
        for c in ("yes", "no"):
            level = level.withColumn(f"n_{c}", F.sum(c).over(same)).withColumn(
                f"t_{c}", F.sum((F.col(c) > 0).cast("long")).over(same))
        if lower is None:
            level = level.withColumn("q_yes", F.lit(FLOOR)).withColumn("q_no", F.lit(FLOOR))
        else:
            level = level.withColumn("tail", F.substring("gram", 2, k)).join(lower, "tail")
        p = {c: F.when(F.col(f"n_{c}") + F.col(f"t_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (
            F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")) for c in ("yes", "no")}
        level = cut(level.select("gram", "often", p["yes"].alias("q_yes"), p["no"].alias("q_no")))
        lower = level.select(F.col("gram").alias("tail"), "q_yes", "q_no")
    return level.select("gram", "often", (F.log("q_yes") - F.log("q_no")).alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """The score from which accepting separates scores (score, verdict, n) best, by the mean of both classes' recall.

    It lies midway between the scores that it parts. Ties take the smallest; 0 where a class has no row. Scores are counted by STEP within REACH, so few rows return.
    """
    step = F.round(F.least(F.greatest("score", F.lit(-REACH)), F.lit(REACH)) / STEP).cast("long")
    yes, no = (F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)) for v in ("allow", "block"))
    steps = scores.groupBy(step.alias("s")).agg(yes.alias("yes"), no.alias("no"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    judged = steps.withColumn("all_yes", F.sum("yes").over(everything)).withColumn(
        "all_no", F.sum("no").over(everything)).where("all_yes > 0 and all_no > 0")
    gain = (F.col("all_yes") - F.coalesce(F.sum("yes").over(before), F.lit(0))) / F.col("all_yes") + F.coalesce(
        F.sum("no").over(before), F.lit(0)) / F.col("all_no")
    below = F.coalesce(F.lag("s").over(everything.orderBy("s")), F.col("s"))
    best = judged.withColumn("gain", gain).withColumn("middle", (F.col("s") + below) / 2).orderBy(
        F.desc("gain"), "s").limit(1).collect()
    return best[0]["middle"] * STEP if best else 0.0


def judged_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """pages with host, path, rule, verdict and score (of the models; null where a rule decides).

    What rules allow or block are the accepted and rejected URLs; every one of their rows counts in the models but for
    those with crc32(url) mod 5 = 0, which set the threshold on the length-normalised log-likelihood difference. Each
    distinct URL is cut into grams once, with its number of rows as weight. A null url counts as an empty one, has no
    rule and is judged by the models; repeated rows agree; an empty table gives no rows; other columns pass through,
    columns named like a result are replaced.
    """
    new = ("host", "path", "rule", "verdict", "score")
    own, guess = unused("_url", pages), unused("guess", pages)
    rows = pages.select([F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]).withColumn(
        own, F.coalesce(F.col("url").cast("string"), F.lit("")))
    host, path = host_and_path(F.col("_url"))
    urls = cut(rows.groupBy(F.col(own).alias("_url")).agg(F.count("*").alias("n")).withColumn("host", host).withColumn("path", path))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("verdict", verdict)
    held = F.crc32("_url") % 5 == 0
    weights = [F.when((F.col("verdict") == v) & ~held, F.col("n")).otherwise(0).alias(c)
               for v, c in (("allow", "yes"), ("block", "no"))]
    apart = urls.select("n", *weights, F.explode(grams(F.col("_url"), order)).alias("gram"))
    counts = cut(apart.groupBy("gram").agg(F.count("*").alias("often"), F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    table = cut(log_ratios(counts, order))
    asked = urls.where(F.col("verdict").isNull() | held)
    parts = asked.select("_url", F.explode(grams(F.col("_url"), order)).alias("gram"))
    if table.count() <= BROADCAST_GRAMS:
        parts = parts.join(F.broadcast(table.drop("often")), "gram")
    else:
        parts = hot_join(parts, table, ["gram"], "often")
    scores = cut(asked.join(parts.groupBy("_url").agg(F.avg("ratio").alias("score")), "_url").select(
        "_url", "n", "verdict", "score"))
    limit = threshold(scores.where("verdict is not null"))
    found = scores.where("verdict is null").select(
        F.col("_url").alias(own), "n", "score", F.when(F.col("score") >= limit, "allow").otherwise("block").alias(guess))
    host, path = host_and_path(F.col(own))
    out = hot_join(rows, found, [own], "n", "left").withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, guess)).drop(own, guess)
