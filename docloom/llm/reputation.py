"""URL filters: listed rules first, then host reputation shrunk by empirical Bayes.

Labelled page outcomes (is the page's document good?) are counted by host, registered domain and
suffix. Each level's beta prior has the mean of the level above and a weight that the level's own
spread tells (moments of the beta-binomial); a host is allowed if the lower bound of its posterior
good share reaches MIN_GOOD. Hosts without labels inherit, with all the doubt of their level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize

#: (verdict, host, path); a list that fits into one expression.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
         ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MIN_GOOD = 0.6
#: Standard deviations below the posterior mean that the bound lies.
DOUBT = 1.645
#: A level's weight in pages, within these limits.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits columns host and path; null where none does.

    A rule fits its host and the host's subdomains, if the path starts with the rule's.
    """
    rule = verdict = None
    for v, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = (F if rule is None else rule).when(fits, F.lit(host + path))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _weight(groups: DataFrame) -> tuple[float, float]:
    """Mean of the groups' shares, and the prior's weight in pages, from (n, k) by moments."""
    r = groups.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum("k"), F.sum(F.col("n").cast("double") * F.col("n")),
                                  F.sum(F.col("k").cast("double") * F.col("k") / F.col("n"))).first()
    number, n, k = r[0], float(r[1] or 0), float(r[2] or 0)
    if not n:
        return 0.5, LEAST_WEIGHT
    mean = k / n
    spread, room = r[4] - mean * mean * n, n - r[3] / n - (number - 1)
    if number < 2 or room <= 0 or not 0 < mean < 1:
        return mean, MOST_WEIGHT
    alike = (spread / (mean * (1 - mean)) - (number - 1)) / room
    return mean, MOST_WEIGHT if alike <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / alike - 1))


def hosts(outcomes: DataFrame) -> DataFrame:
    """(host, good): lower bound of the good share of each host, from (host, outcome 1, 0 or null).

    The registered domain is the last two labels, the suffix the last one.
    """
    counts = materialize(outcomes.groupBy("host").agg(
        F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("k")).select(
        "host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "n", "k"), "hosts")
    levels = {c: counts.groupBy(c).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) for c in ("suffix", "domain")}
    levels["host"] = counts
    mean, weight = _weight(levels["suffix"])
    # the suffixes' posterior means, then the domains' around them, then the hosts'
    up = levels["suffix"].select("suffix", ((F.col("k") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))).alias("above"))
    for level, key in (("domain", "suffix"), ("host", "domain")):
        _, weight = _weight(levels[level])
        rows = levels[level] if level == "host" else levels[level].withColumn("suffix", F.substring_index("domain", ".", -1))
        a, b = F.col("k") + F.lit(weight) * F.col("above"), F.col("n") - F.col("k") + F.lit(weight) * (1 - F.col("above"))
        share = a / (a + b)
        rows = rows.join(up, key)
        if level == "domain":
            up = rows.select("domain", share.alias("above"))
    bound = share - F.lit(DOUBT) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return rows.select("host", bound.alias("good"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The document a page shows is the number after its path's language; its label's quality is the
    outcome. Null urls and urls without :// have empty host and path and are judged as that host;
    repeated rows are judged alike and count as often as they occur; without labels the bound is
    that of no data. An empty table gives no rows; other columns are not looked at.
    """
    rule, verdict = listed()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("long").alias("outcome"))
    shown = F.regexp_extract("path", r"^/[a-z]{2}/([0-9]{1,18})", 1)
    rows = materialize(rows.withColumn("shown", F.when(shown != "", shown.cast("long"))), "urls")
    outcomes = rows.join(known, rows["shown"] == known["doc_id"], "left").select("host", "outcome")
    good = hosts(outcomes).withColumnRenamed("host", "_host")
    return rows.join(good, F.col("host") == F.col("_host")).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("good") >= MIN_GOOD, "allow").otherwise("block")).alias("verdict"),
        F.col("good").alias("good_bound"))


SQL = r"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
known AS (SELECT doc_id, min(quality) AS outcome FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT host, count(outcome) AS n, coalesce(sum(outcome), 0) AS k,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix
  FROM urls LEFT JOIN known ON try_cast(nullif(regexp_extract(path, '^/[a-z]{2}/([0-9]{1,18})', 1), '') AS BIGINT) = known.doc_id
  GROUP BY host),
grouped AS (
  SELECT 'suffix' AS level, suffix AS name, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM counts GROUP BY suffix
  UNION ALL SELECT 'domain', domain, sum(n), sum(k) FROM counts GROUP BY domain
  UNION ALL SELECT 'host', host, n, k FROM counts),
moments AS (
  SELECT level, count(*) AS number, sum(n) AS n, sum(k) / sum(n) AS mean, sum(k * k / n) - (sum(k) / sum(n)) ** 2 * sum(n) AS spread,
         sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room
  FROM grouped WHERE n > 0 GROUP BY level),
weights AS (
  SELECT level, mean,
         CASE WHEN number < 2 OR room <= 0 OR mean <= 0 OR mean >= 1 OR spread / (mean * (1 - mean)) - (number - 1) <= 0 THEN 10000.0
              ELSE least(10000.0, greatest(1.0, room / (spread / (mean * (1 - mean)) - (number - 1)) - 1)) END AS weight
  FROM moments),
s AS (SELECT name AS suffix, (k + weight * mean) / (n + weight) AS above FROM grouped JOIN weights USING (level) WHERE level = 'suffix'),
d AS (
  SELECT name AS domain, (k + weight * above) / (n + weight) AS above
  FROM grouped JOIN weights USING (level) JOIN s ON s.suffix = string_split(name, '.')[-1] WHERE level = 'domain'),
h AS (
  SELECT host, k + weight * above AS a, n - k + weight * (1 - above) AS b
  FROM counts JOIN d USING (domain), (SELECT weight FROM weights WHERE level = 'host') w),
ruled AS (
  SELECT u.*, h.a / (h.a + h.b) - 1.645 * sqrt(h.a * h.b / ((h.a + h.b) ** 2 * (h.a + h.b + 1))) AS good_bound,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM urls u JOIN h USING (host))
SELECT page_id, host, path, rule, good_bound,
       CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN good_bound >= 0.6 THEN 'allow' ELSE 'block' END AS verdict
FROM ruled
"""
