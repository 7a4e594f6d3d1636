"""URL rules: host-suffix and path-prefix expressions of each URL, equi-joined to the rules on a short hash prefix.

All of it is DataFrame expressions. Each distinct URL expands into its host's suffixes (at every dot) times the
prefixes of its path that are as long as some rule's path; the expressions meet the rules on the first 4 bytes of their
SHA-256 and are then confirmed by the whole digest. The longest confirmed rule wins (host and path together; of equally
long ones the longer host; of rules that say both, block).

Null URL or no ``://``: empty host and path, no rule. Repeated URLs are judged once. An empty table gives an empty one.
The rules are a table of any size: nothing of them is collected but the distinct lengths of their paths (bounded by the
longest path), and whether the join broadcasts them is left to the optimizer's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT_VERDICT = "allow"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    lengths = F.array(*[F.lit(int(r[0])) for r in rules.select(F.length("path")).distinct().orderBy(F.length("path")).collect()])
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    known = rules.select(
        digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.col("verdict").alias("rule_verdict"),
    ).withColumn("short", F.substring("digest", 1, 8))

    urls = pages.select(F.col(url).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", url_host(F.col("_url")).alias("h"), url_path(F.col("_url")).alias("p"))
    labels = F.split("h", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    said = urls.select("_url", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: digest(h, p))))).alias("full"))
    best = (
        said.withColumn("short", F.substring("full", 1, 8))
        .join(known, "short")
        .where("full = digest")
        .groupBy("_url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", (F.col("rule_verdict") == "block").alias("hard"), "rule", "rule_verdict")).alias("best"))
        .select("_url", F.col("best.rule").alias("_rule"), F.col("best.rule_verdict").alias("_verdict"))
    )
    out = pages.join(best, F.col(url) == F.col("_url"), "left")
    keep = [pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *keep,
        url_host(pages[url]).alias("host"),
        url_path(pages[url]).alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages
), p as (
  select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
), r(rule_verdict, rhost, rpath) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ids as (select row_number() over () as rid, * from p), m as (
  select rid, rhost || rpath as rule, rule_verdict,
    row_number() over (partition by rid order by length(rhost || rpath) desc, length(rhost) desc) as k
  from ids join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
from ids left join (select * from m where k = 1) m2 on ids.rid = m2.rid
"""
