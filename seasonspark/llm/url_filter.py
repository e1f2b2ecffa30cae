"""URL filter by empirical-Bayes host reputation, with rules that come first.

Labelled pages are good or bad. A host's bad share is shrunk towards its
registered domain's, that towards its suffix's, that towards the share of all,
each level through a beta prior whose strength is fitted over the level's
groups by moments of the beta-binomial. A url is blocked if a lower bound, mean
less Z standard deviations of a posterior, is above the limit: the posterior of
its host, of its registered domain where no page of the host is labelled, of its
suffix where none of the domain is, or else of all pages.

Defined cases: a null url, or one without ://, has an empty host and path,
which are judged like any other host; only A-Z is lower-cased; labels with null
ids or outcomes are left out; several labels of a page count each; without
labels nothing is blocked but by rules; repeated rows repeat their verdict; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, join_uneven, table

#: Standard deviations below the posterior mean, and the bad share above which a host is blocked.
Z, LIMIT = 1.645, 0.5
#: Suffixes of two labels, unless the caller brings another list.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.za", "co.in")
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
    ("block", "example.net/de/8"), ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_places(pages: DataFrame, url: str = "url", suffixes=LONG_SUFFIXES) -> DataFrame:
    """Adds host, path, domain and suffix. suffixes: those of two labels."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    out = pages.withColumns({"host": host, "path": F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)})
    n = F.when(F.substring_index("host", ".", -2).isin(*suffixes), 2).otherwise(1)
    return out.withColumn("suffix", F.when(n == 2, F.substring_index("host", ".", -2)).otherwise(F.substring_index("host", ".", -1))).withColumn(
        "domain", F.when(n == 2, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    )


def matched_rule(rules) -> F.Column:
    """verdict and text of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def strength(groups: DataFrame) -> float:
    """How many observations the prior m of groups with n outcomes, y of them bad, is worth."""
    p, v = F.col("y") / F.col("n"), F.col("m") * (1 - F.col("m"))
    r = groups.agg(F.sum(F.col("n") * (p - F.col("m")) ** 2 - v).alias("a"), F.sum((F.col("n") - 1) * v).alias("b")).first()
    rho = min(0.9, max(1e-3, r.a / r.b)) if r.b else 1e-3
    return 1 / rho - 1


LEVELS = (["suffix"], ["domain", "suffix"], ["host", "domain", "suffix"])


def reputations(outcomes: DataFrame) -> tuple[list[DataFrame], float]:
    """Of each level, suffix first, its keys, mean and low (the bound), from rows of host, domain, suffix and bad; and the bound of all.

    bad: 1 or 0 for each outcome.
    """
    # One row a labelled host: all levels are drawn from it.
    level = cut(outcomes.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("y")), "outcomes")
    total = level.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    # One bad and one good outcome more than there are: the prior of all is never certain.
    n, y = (total.n or 0) + 2, (total.y or 0) + 1
    mean = y / n
    made = []
    for keys in LEVELS:
        g = level.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        g = g.withColumn("m", F.lit(mean)) if not made else g.join(made[-1].select(*keys[1:], F.col("mean").alias("m")), keys[1:])
        g = cut(g, "reputations")
        k = strength(g)
        g = g.withColumn("t", F.lit(k) + F.col("n")).withColumn("mean", (F.col("m") * k + F.col("y")) / F.col("t"))
        sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("t") + 1))
        made.append(g.select(*keys, "mean", (F.col("mean") - Z * sd).alias("low")))
    return made, mean - Z * (mean * (1 - mean) / (n + 1)) ** 0.5


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", limit: float = LIMIT, suffixes=LONG_SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, low (the bound that decides) and level (whose it is: host, domain, suffix or all).

    outcomes: page id under the same name, and bad (1 or 0).
    """
    placed = with_places(pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")), "url", suffixes)
    known = outcomes.where(F.col("bad").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("page_id"), F.col("bad").cast("int").alias("bad"))
    levels, of_all = reputations(placed.join(known, "page_id").select("host", "domain", "suffix", "bad"))
    # Each host once: the bounds are looked up by hosts, not by pages.
    hosts = cut(placed.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("_n")), "hosts")
    for keys, level in zip(LEVELS, levels, strict=True):
        hosts = hosts.join(level.select(*keys, F.col("low").alias(f"_{keys[0]}")), keys, "left")
    bounds = [F.when(F.col(f"_{keys[0]}").isNotNull(), F.struct(F.col(f"_{keys[0]}").alias("low"), F.lit(keys[0]).alias("level"))) for keys in LEVELS[::-1]]
    hosts = cut(hosts.select("host", "_n", F.coalesce(*bounds, F.struct(F.lit(of_all).alias("low"), F.lit("all").alias("level"))).alias("_b")), "host-bounds")
    total = hosts.agg(F.sum("_n")).first()[0] or 0
    out = join_uneven(placed, hosts, ["host"], "_n", total).withColumn("_r", matched_rule(rules))
    own = F.when(F.col("_b.low") > limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "_b.low", "_b.level")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose doc_id is the page's id; bad: low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judged(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict", "level")


def fits_sql(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"


def level_sql(name: str, keys: list[str], up: str | None) -> str:
    """The groups of a level with their prior, its strength, and their posterior's mean and bound."""
    on, of = ", ".join(f"g.{k}" for k in keys), " AND ".join(f"g.{k} = u.{k}" for k in keys[1:])
    prior = "t.mean AS m FROM g CROSS JOIN total t" if up is None else f"u.mean AS m FROM g JOIN {up} u ON {of}"
    return f"""{name}_g AS (
  WITH g AS (SELECT {", ".join(keys)}, sum(n) AS n, sum(y) AS y FROM outcomes GROUP BY ALL) SELECT {on}, g.n, g.y, {prior}
), {name}_k AS (
  SELECT coalesce(1 / least(0.9, greatest(0.001, sum(n * (y / n - m) * (y / n - m) - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0))) - 1, 999) AS k FROM {name}_g
), {name} AS (
  SELECT {", ".join(keys)}, mean, mean - {Z} * sqrt(mean * (1 - mean) / (t + 1)) AS low
  FROM (SELECT *, k + n AS t, (m * k + y) / (k + n) AS mean FROM {name}_g CROSS JOIN {name}_k)
)"""


LONGEST_FIRST = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
OP5_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), q AS (
  SELECT *, string_split(host, '.') AS l,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) THEN 2 ELSE 1 END AS long
  FROM p
), placed AS (
  SELECT page_id, host, path, array_to_string(l[-long:], '.') AS suffix, array_to_string(l[-long - 1:], '.') AS domain FROM q
), outcomes AS (
  SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS y
  FROM placed JOIN labels ON doc_id = page_id GROUP BY ALL
), total AS (
  SELECT (coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean, coalesce(sum(n), 0) + 2 AS n FROM outcomes
), {level_sql("s", LEVELS[0], None)}, {level_sql("d", LEVELS[1], "s")}, {level_sql("h", LEVELS[2], "d")}
SELECT page_id, placed.host, path,
       CASE {" ".join(f"WHEN {fits_sql(r).replace('host', 'placed.host')} THEN '{r}'" for _, r in LONGEST_FIRST)} END AS rule,
       CASE {" ".join(f"WHEN {fits_sql(r).replace('host', 'placed.host')} THEN '{v}'" for v, r in LONGEST_FIRST)}
            WHEN coalesce(h.low, d.low, s.low, total.mean - {Z} * sqrt(total.mean * (1 - total.mean) / (total.n + 1))) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN h.low IS NOT NULL THEN 'host' WHEN d.low IS NOT NULL THEN 'domain' WHEN s.low IS NOT NULL THEN 'suffix' ELSE 'all' END AS level
FROM placed CROSS JOIN total
LEFT JOIN s ON s.suffix = placed.suffix
LEFT JOIN d ON d.domain = placed.domain AND d.suffix = placed.suffix
LEFT JOIN h ON h.host = placed.host
"""
