"""URL filter: host-suffix and path-prefix expressions against a rule table.

Each distinct URL is expanded into ``host suffix + path prefix`` expressions.
An expression is joined to the rules on the first four bytes of its SHA-256
digest alone; the rules that share those bytes come as an array, in which the full
digest confirms the hit, and the longest rule wins.  All of it is DataFrame
expressions.

Defined results
  * null URL or one without ``://``: empty host and path, no rule, the default
    verdict;
  * very long URLs are judged whole; an expression's path is no longer than the
    longest rule's path;
  * empty tables give empty results, an empty rule table the default verdict;
  * repeated rows stay repeated, extra columns are kept; helper names never
    clash because the work is done on a table of distinct URLs;
  * ties: of two rules that fit, the longer ``host + path`` wins, then the
    longer host, then ``block`` over ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import fresh

#: Rules of the query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Hex digits of the short hash that is joined on (four bytes).
SHORT = 8

#: Bytes of rules up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    no_query = F.regexp_extract(after, r"(?s)\A([^?#]*)", 1)
    host = F.translate(F.regexp_extract(no_query, r"(?s)\A([^/]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(no_query, r"(?s)\A[^/]*(.*)\z", 1)
    return host, path


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) with digests; of equal rules ``block`` stays."""
    expression = F.concat(F.col("host"), F.col("path"))
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(
            "host",
            "path",
            "verdict",
            F.concat_ws("\x00", "host", "path").alias("_key"),
            F.length(expression).alias("_length"),
        )
        .withColumn("_digest", F.sha2("_key", 256))
        .withColumn("_short", F.substring("_digest", 1, SHORT))
    )


def by_short_hash(ruled: DataFrame) -> DataFrame:
    """(_short, _rules): all rules that share a short hash, as one array."""
    rule = F.struct(
        F.col("_length").alias("n"),
        F.length("host").alias("h"),
        F.col("verdict").alias("verdict"),
        F.concat("host", "path").alias("rule"),
        F.col("_digest").alias("digest"),
    )
    return ruled.groupBy("_short").agg(F.collect_list(rule).alias("_rules"))


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Path prefixes are taken at every length that some rule's path has, so that
    "starts with" holds for rules that do not end at a slash too.  Only the set
    of lengths (at most the longest rule path) and the byte count of the rules
    come to the driver.
    """
    ruled = prepare_rules(rules)
    facts = ruled.agg(
        F.collect_set(F.length("path")).alias("lengths"),
        F.coalesce(F.sum(F.length("_key") + 140), F.lit(0)).alias("bytes"),
    ).first()
    lengths = sorted(facts["lengths"])
    small = facts["bytes"] <= broadcast_bytes

    work = pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    host, path = split_url(F.col("url"))
    work = work.select("url", host.alias("host"), path.alias("path")).where(F.col("host") != "")
    hosts = host_suffixes(F.col("host"))
    paths = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(
            hosts,
            lambda h: F.transform(paths, lambda n: F.concat_ws("\x00", h, F.col("path").substr(F.lit(1), n))),
        )
    )
    exploded = work.select("url", F.explode(keys).alias("_k")).select("url", F.sha2("_k", 256).alias("_d"))
    exploded = exploded.select("url", "_d", F.substring("_d", 1, SHORT).alias("_s"))
    side = by_short_hash(ruled)
    side = F.broadcast(side) if small else side
    near = exploded.join(side, F.col("_s") == F.col("_short"))
    # the digest is compared inside the array: as a join condition it would be hashed with the short one
    hit = F.filter("_rules", lambda r: r["digest"] == F.col("_d"))
    hits = near.select("url", F.array_max(hit).alias("best")).where(F.col("best").isNotNull())
    best = hits.groupBy("url").agg(F.max("best").alias("best"))
    u, b = fresh(pages, "_url", "_best")
    best = best.select(F.col("url").alias(u), F.col("best").alias(b))
    # rows without a URL would all meet in one task of the join
    blank = pages.where(F.col(url).isNull()).withColumn(u, F.lit(None).cast("string")).withColumn(b, F.lit(None).cast(best.schema[b].dataType))
    joined = pages.where(F.col(url).isNotNull()).join(best, F.col(url) == F.col(u), "left").unionByName(blank)
    host, path = split_url(F.col(url))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return joined.select(
        *kept,
        host.alias("host"),
        path.alias("path"),
        F.col(b)["rule"].alias("rule"),
        F.coalesce(F.col(b)["verdict"], F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'),
  ('net','/es/','block'), ('net','/fr/','block')),
cut AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
          ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.rverdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE k = 1
"""
