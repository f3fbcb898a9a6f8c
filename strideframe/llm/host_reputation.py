"""URL filter by fixed rules and, where none fits, by empirical-Bayes host reputation.

Labelled page outcomes are counted by host.  A host's bad rate is shrunk
towards its registered domain's, that towards its suffix's, that towards the
rate of all; how strongly is estimated at each level.  A host is blocked if
the lower posterior bound of its bad rate is above the limit.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import split_join
from .shrinkage import PRIOR_SQL, lower_bound, prior, shrunk

# Fixed values: (verdict, host, path); a rule is a short list that the caller gives.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is blocked if its bad rate lies above this with confidence (``Z`` posterior standard deviations).
LIMIT = 0.5
Z = 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none; equally long ones in the order of their text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_rate of every row of ``pages`` (page_id, url, outcome_id).

    ``outcomes`` has one row (outcome_id, bad) per labelled outcome id; pages
    without a label count for nothing.  Hosts without any labelled page have
    their domain's rate, and so on upwards; the empty host is a host like any
    other.  Repeated pages each count.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", "outcome_id", host.alias("host"), path.alias("path"))
    labelled = split_join(rows.select("outcome_id", "host"), outcomes.select("outcome_id", "bad"), ["outcome_id"], "left")
    hosts = checkpoint(labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("f"))
                       .withColumn("domain", F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0))
                       .withColumn("suffix", F.regexp_extract("host", r"[^.]+$", 0)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_domain"), F.sum("f").alias("f_domain"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n_suffix"), F.sum("f").alias("f_suffix"))
    rate, at_suffix = prior(suffixes, "n_suffix", "f_suffix")
    _, at_domain = prior(domains, "n_domain", "f_domain")
    _, at_host = prior(hosts, "n", "f")
    suffixes = suffixes.select("suffix", shrunk(F.col("n_suffix"), F.col("f_suffix"), F.lit(rate), at_suffix).alias("suffix_rate"))
    domains = split_join(domains, suffixes, ["suffix"]).select(
        "domain", shrunk(F.col("n_domain"), F.col("f_domain"), F.col("suffix_rate"), at_domain).alias("domain_rate"))
    known = split_join(hosts, domains, ["domain"]).select(
        "host", F.round(shrunk(F.col("n"), F.col("f"), F.col("domain_rate"), at_host), 6).alias("bad_rate"),
        (lower_bound(F.col("n"), F.col("f"), F.col("domain_rate"), at_host, z) > limit).alias("out"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return split_join(rows, known, ["host"]).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("out"), "block").otherwise("allow")).alias("verdict"), "bad_rate")


def judge_labelled(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``judge`` with the outcomes of the documents that the pages' addresses name.

    The number after the language in a path (``/en/123.html``) is the id of the
    page's document; a document labelled toxic or of quality 0 is a bad outcome.
    """
    path = host_and_path(F.col("url").cast("string"))[1]
    number = F.regexp_extract(path, "^/[^/]*/([0-9]{1,18})", 1)
    outcomes = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("outcome_id")).agg(
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    return judge(pages.select("page_id", "url", F.when(number != "", number.cast("long")).alias("outcome_id")), outcomes, **options)


SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
    SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw_host, rest FROM cut
), rows AS (
    SELECT page_id, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host,
           coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path FROM split
), outcomes AS (
    SELECT doc_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), labelled AS (
    SELECT host, bad FROM rows LEFT JOIN outcomes ON doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') AS BIGINT)
), hosts AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS f, regexp_extract(host, '([^.]+\\.)?[^.]+$') AS domain,
           regexp_extract(host, '[^.]+$') AS suffix FROM labelled GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(f) AS f FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(f) AS f FROM hosts GROUP BY suffix),
at_suffix AS ({PRIOR_SQL.format(groups="suffixes")}), at_domain AS ({PRIOR_SQL.format(groups="domains")}), at_host AS ({PRIOR_SQL.format(groups="hosts")}),
s AS (SELECT suffix, (strength * rate + f) / (strength + n) AS m FROM suffixes, at_suffix),
d AS (SELECT domain, (strength * m + f) / (strength + n) AS m FROM domains JOIN s USING (suffix), at_domain),
h AS (SELECT host, (strength * m + f) / (strength + n) AS p, strength + n AS w FROM hosts JOIN d USING (domain), at_host),
fits AS (
    SELECT page_id, host, path,
           CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM rows)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN p - {Z} * sqrt(p * (1 - p) / (w + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       round(p, 6) AS bad_rate
FROM fits JOIN h USING (host)
"""
