"""URL filtering by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule_id, expression, action, priority): a host suffix, and a path prefix after it.
RULES = [
    (1, "spam-farm.example.org/", "block", 10),
    (2, "ththon.example.com/fr/", "block", 5),
    (3, "example.net/es/", "block", 5),
    (4, "tionsh.example.net/es/", "allow", 5),
    (5, "blog.tionble.example.com/", "block", 1),
    (6, "blog.tionble.example.com/en/", "allow", 1),
    (7, "m.tiontion.example.com/de/", "block", 1),
    (8, "example.org/en/", "allow", 0),
    (9, "www.spam-farm.example.org/en/", "allow", 3),
    (10, "ththan.example.net/", "block", 1),
    (11, "adult.example.com/", "block", 10),
    (12, "tracker.example.net/", "block", 10),
    (13, "malware.example.org/", "block", 10),
]


def _resolved(path: Column) -> Column:
    """A path without its '.' and '..' segments, however many; most have none and are left alone."""
    last = F.element_at(F.split(path, "/"), -1)
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    up = F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    tail = F.when(F.size(up) == 0, "").when(last.isin("", ".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(up, "/"), tail)).otherwise(path)


def canonical(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL: no scheme, user, port or fragment; host in lower case.

    Tabs and newlines are dropped; runs of dots in the host and of slashes in the path become one,
    and '.' and '..' segments are resolved.
    """
    u = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), "[\t\r\n]", "")), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    authority = F.regexp_extract(u, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(host, r"\.{2,}", "."), r"^\.|\.$", ""))
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = _resolved(F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/{2,}", "/"))
    path = F.when(path == "", "/").otherwise(path)
    return host, path, F.regexp_extract(rest, r"\?(.*)$", 1)


def expanded(urls: DataFrame, labels: int, depth: int, url: str = "url") -> DataFrame:
    """(url, expression, host_len, path_len), one row for each expression of each distinct URL that has a host.

    Hosts: the exact one and those formed by dropping leading labels (never the last alone), of
    `labels` labels at most; an IPv4 address only as it is. Paths: with its query, without it,
    and the directories above it, `depth` at most, the root being the first. No rule is longer, so none is lost.
    """
    host, path, query = canonical(F.col(url))
    parts = urls.select(F.col(url).alias("url")).where(F.col(url).isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"), query.alias("query")).where("host <> ''")
    names = F.split("host", r"\.")
    n = F.size(names)
    is_ip = F.col("host").rlike(r"^\d+(\.\d+){3}$")
    suffixes = F.when((n > 2) & ~is_ip & (F.lit(labels) >= 2), F.transform(F.sequence(F.lit(2), F.least(F.lit(max(labels, 2)), n - 1)), lambda i: F.concat_ws(".", F.slice(names, n - i + 1, i)))).otherwise(F.array().cast("array<string>"))
    dirs = F.split("path", "/")  # '', a, b, ..., last
    deep = F.least(F.lit(depth), F.size(dirs) - 1)
    prefixes = F.when(deep >= 1, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(F.concat_ws("/", F.slice(dirs, 1, i)), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    paths = F.array_append(F.array_append(prefixes, F.col("path")), F.when(F.col("query") != "", F.concat("path", F.lit("?"), "query")))
    rows = parts.select("url", F.explode(F.array_distinct(F.array_append(suffixes, F.col("host")))).alias("h"), F.array_distinct(F.array_compact(paths)).alias("paths"))
    return rows.select("url", "h", F.explode("paths").alias("p")).select("url", F.concat("h", "p").alias("expression"), F.length("h").alias("host_len"), F.length("p").alias("path_len"))


def _hashed(df: DataFrame) -> DataFrame:
    digest = F.unhex(F.sha2("expression", 256))
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 4))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url, action, rule_id): what the rules say of each page's URL.

    pages: page_id and url; other columns are not read. rules: rule_id BIGINT, expression (host suffix,
    slash, path prefix, as of a canonical URL), action, priority INT. Expressions meet rules on the first four
    bytes of their SHA-256; whole digests confirm. URLs are expanded as deep as the deepest rule, which the rules are asked for first. Of several rules that apply the highest
    priority wins, then the longest host, the longest path, 'allow' before others, and the least rule_id.
    Pages that no rule names, with a null URL or one without a host, have the default action and no
    rule. Empty and very long URLs are taken like others. Rules with a null expression or action never apply; a null priority is 0. Every row of pages gives one row, repeated ones too.
    """
    asked = _hashed(rules.select("rule_id", F.col("expression"), "action", F.coalesce("priority", F.lit(0)).alias("priority")).where("expression IS NOT NULL AND action IS NOT NULL")).select("rule_id", "action", "priority", "short", F.col("digest").alias("full"))
    rule_host, rule_path = F.substring_index("expression", "/", 1), F.regexp_extract("expression", r"^[^/]*([^?]*)", 1)
    labels, depth = rules.agg(F.max(F.size(F.split(rule_host, r"\."))), F.max(F.size(F.split(rule_path, "/")) - 1)).first()
    # Spark broadcasts the rules only where their size is under its threshold; else both sides meet by the short hash.
    hit = _hashed(expanded(pages, labels or 0, depth or 0)).join(asked, "short").where("digest = full")
    best = F.struct("priority", "host_len", "path_len", (F.col("action") == "allow").alias("allows"), (-F.col("rule_id")).alias("order"), "action", "rule_id")
    won = hit.groupBy("url").agg(F.max(best).alias("best"))
    return pages.select("page_id", "url").join(won, "url", "left").select("page_id", "url", F.coalesce("best.action", F.lit(default)).alias("action"), F.col("best.rule_id").alias("rule_id"))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id long, expression string, action string, priority int")


ORACLE = r"""
WITH rules(rule_id, expression, action, priority) AS (VALUES %s),
a AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
b AS (SELECT *, lower(regexp_replace(regexp_extract(u, '^[^/?]*'), ':\d*$', '')) AS host, regexp_extract(u, '^[^/?]*([^?]*)', 1) AS p, regexp_extract(u, '\?(.*)$', 1) AS q FROM a),
c AS (SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM b),
r AS (SELECT *, regexp_extract(expression, '^[^/]*') AS rh, regexp_extract(expression, '^[^/]*(/.*)$', 1) AS rp FROM rules),
m AS (SELECT c.page_id, c.url, r.action, r.rule_id, row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY priority DESC NULLS LAST, length(rh) DESC, length(rp) DESC, r.action = 'allow' DESC, r.rule_id) AS rn
 FROM c LEFT JOIN r ON (c.host = rh OR (ends_with(c.host, '.' || rh) AND len(string_split(rh, '.')) >= 2))
  AND (rp = c.path OR rp = c.path || '?' || c.q OR (ends_with(rp, '/') AND starts_with(c.path, rp))))
SELECT page_id, url, coalesce(action, 'allow') AS action, rule_id FROM m WHERE rn = 1
""" % ", ".join(f"({i}, '{e}', '{a}', {p})" for i, e, a, p in RULES)
