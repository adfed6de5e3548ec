"""URL filter: host and path rules, then a list of canonical URLs.

A blocked Bloom filter of the listed URLs passes possible hits to an exact hash
join that removes its false positives. The rules are few and fixed, so they are
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import stored, table

#: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Host labels of the sites whose pages the production list names.
LISTED_LABELS = ("adult-x", "casino-win", "free-bets", "spam-farm")
FILTER_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column, url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last ``/``, query without tracking; no fragment, no scheme."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^&=]*|ref)(=[^&]*)?(?=&|\z)", ""), r"^&", "")
    site = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/\z", ""))
    return F.when(query == "", site).otherwise(F.concat(site, F.lit("?"), query))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null if none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, on, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(start))
        text, verdict = F.when(fits, F.lit(on + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every row of ``pages``: the rule's, else ``block`` if the canonical URL is in ``listed``.

    ``listed`` has a string column ``canonical``; nulls and repeats in it do not
    matter, and it may be empty. A url that is null or has no ``://`` has empty
    host and path, fits no rule, and is allowed, since an empty canonical URL is
    never listed. Repeated rows are judged each; extra columns are ignored.

    Returns ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``listed``.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path"), url)).withColumn("h", F.xxhash64("canonical"))
    names = stored(listed.select("canonical").filter("canonical <> ''").distinct().withColumn("h", F.xxhash64("canonical")), "listed")
    bits = bloom.build(names, "h", bloom.block_count(names.count(), FILTER_BYTES))
    # Certain misses stay where they are. Possible hits meet the list; a hot URL is one row of the list and many of the pages, which a skewed join divides.
    possible, missed = (part.drop("h", "url") for part in bloom.split(rows, "h", bits))
    hits = possible.join(names.select("canonical", F.lit(True).alias("listed")), "canonical", "left").select("id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    rows = hits.unionByName(missed.select("id", "host", "path", F.lit(False).alias("listed")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list that the query uses: canonical URLs under the host labels in ``LISTED_LABELS``."""
    url = F.col("url")
    rows = pages.select("url", host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.filter(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select(canonical(F.col("host"), F.col("path"), url).alias("canonical"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_urls(pages))


ORACLE = {
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS q FROM pages),
q AS (
  SELECT page_id, host, path, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '') AS site,
         array_to_string(list_filter(string_split(q, '&'), lambda x: NOT regexp_full_match(x, '(utm_[^&=]*|ref)(=.*)?')), '&') AS kept FROM p),
c AS (SELECT page_id, host, path, CASE WHEN kept = '' THEN site ELSE site || '?' || kept END AS canonical FROM q),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'free-bets', 'spam-farm'])),
r AS (
  SELECT c.*, l.canonical IS NOT NULL AS listed,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c LEFT JOIN l USING (canonical))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
}
