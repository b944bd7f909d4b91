"""Block and allow rules for urls, carried along redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.tables import table
from voxtally.operators.components import connected_components
from voxtally.session import materialize

ALLOW, BLOCK = "allow", "block"

# The rules of the query, as (host, path, verdict).
RULES = (
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for a url without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """The host with A-Z lower-cased; empty for null and for a url without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path, up to ``?`` or ``#``; empty for null and for a url without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def resource_of(url: Column) -> Column:
    """What redirects and links are compared by: host, path and query; null without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), query))


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(from_url, to_url)``: canonical links and refresh redirects that pages declare.

    Targets may be absolute or relative to the page; those without a host are left out.
    """
    tags = F.regexp_extract_all(
        F.col(html), F.lit(r"(?i)(<link\b[^>]*\bcanonical\b[^>]*>|<meta\b[^>]*\brefresh\b[^>]*>)"), 1
    )
    base = F.col(url)
    found = pages.select(
        base.alias("from_url"),
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("scheme"),
        host_of(base).alias("host"),
        F.regexp_extract(path_of(base), r"^(.*/)?[^/]*$", 1).alias("folder"),
        F.explode(tags).alias("tag"),
    )
    target = (
        F.when(
            F.col("tag").rlike(r"(?i)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b"),
            F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1),
        )
        .when(
            F.col("tag").rlike(r"(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"),
            F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]*)", 1),
        )
        .otherwise(F.lit(""))
    )
    # Kinds: absolute, the same scheme, the same host, another scheme or the page itself, relative.
    to = F.col("target")
    site = F.concat("scheme", F.lit("://"), "host")
    return (
        materialize(found.withColumn("target", target).where("target <> '' AND host <> ''"), "targets")
        .select(
            "from_url",
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.startswith("//"), F.concat("scheme", F.lit(":"), "target"))
            .when(to.startswith("/"), F.concat(site, "target"))
            .when(to.startswith("#") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(site, F.coalesce(F.nullif("folder", F.lit("")), F.lit("/")), "target"))
            .alias("to_url"),
        )
        .where("to_url IS NOT NULL")
    )


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` for every place that a rule fits; the longest rule wins.

    ``places`` has distinct ``(host, path)``. Each host meets the rules of its own domain and of
    those above it by an equality join; of two rules of equal length the allowing one wins.
    """
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    wanted = rules.select(
        F.col("host").alias("domain"),
        F.col("path").alias("_start"),
        F.col("verdict").alias("_verdict"),
    )
    return (
        places.select("host", "path", F.explode(above).alias("domain"))
        .join(wanted, "domain")
        .where(F.col("path").startswith(F.col("_start")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("domain") + F.length("_start")).alias("n"),
                    (F.col("_verdict") == ALLOW).alias("allows"),
                    F.concat("domain", "_start").alias("rule"),
                    F.col("_verdict").alias("verdict"),
                )
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.verdict")
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    links: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``links`` (``from_url``, ``to_url``) are redirects and canonical links: both ends are the same
    resource. A page that a rule fits has the rule's verdict. Any other page takes the verdict of
    its connected component over the links: ``allow`` if a rule allows one of the aliases, else
    ``block`` if a rule blocks one, else ``allow``. Aliases need not be pages themselves.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, have no aliases
    and are allowed. Repeated rows are judged one by one; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        resource_of(F.col("url")).alias("resource"),
    )
    links = materialize(links.select("from_url", "to_url"), "links")
    ends = (
        links.select(
            *(
                F.struct(
                    resource_of(F.col(c)).alias("node"),
                    host_of(F.col(c)).alias("host"),
                    path_of(F.col(c)).alias("path"),
                ).alias(side)
                for c, side in (("from_url", "a"), ("to_url", "b"))
            )
        )
        .where("a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node")
        .distinct()
    )
    ends = materialize(ends, "ends")
    aliases = ends.select("a.*").union(ends.select("b.*")).distinct()
    ruled = match_rules(aliases.select("host", "path").distinct(), rules)
    groups = connected_components(
        aliases.select("node").distinct(),
        ends.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")),
    )
    votes = (
        aliases.join(ruled, ["host", "path"])
        .join(groups, "node")
        .groupBy("component")
        .agg(F.max((F.col("verdict") == ALLOW)).alias("allows"))
    )
    passed_on = (
        groups.join(votes, "component")
        .where("NOT allows")
        .select(F.col("node").alias("resource"), F.lit(BLOCK).alias("passed_on"))
    )
    places = match_rules(rows.select("host", "path").distinct(), rules)
    return (
        rows.join(places, ["host", "path"], "left")
        .join(passed_on, "resource", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("verdict", "passed_on", F.lit(ALLOW)).alias("verdict"),
        )
    )


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return filter_urls(pages, rules_frame(spark), html_links(pages))


OP4_SQL = r"""
WITH RECURSIVE parsed AS (
    SELECT page_id, url, html,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
rows AS (
    SELECT page_id, url, html,
           translate(regexp_extract(rest, '^([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
    FROM parsed
),
rules(domain, start, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
tags AS (
    SELECT host, path, query, unnest(regexp_extract_all(html,
        '(?i)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)')) AS tag
    FROM rows WHERE host <> ''
),
targets AS (
    SELECT host || path || query AS a,
           regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1) AS target
    FROM tags
),
places AS (
    SELECT a, CASE WHEN instr(target, '://') > 0 THEN substr(target, instr(target, '://') + 3) END AS rest
    FROM targets
),
ends AS (
    SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
    FROM places WHERE rest IS NOT NULL
),
links AS (
    SELECT a, host || path || query AS b FROM ends
    UNION SELECT host || path || query AS a, a AS b FROM ends
),
known AS (
    SELECT host || path || query AS node, host, path FROM rows WHERE host <> ''
    UNION SELECT host || path || query, host, path FROM ends
),
reach(a, b) AS (
    SELECT a, a FROM links
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
seeds AS (
    SELECT node, arg_max(verdict, length(domain || start)) AS verdict
    FROM known JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
    GROUP BY node
),
passed AS (
    SELECT r.a AS node, bool_or(s.verdict = 'allow') AS allows
    FROM reach r JOIN seeds s ON r.b = s.node GROUP BY r.a
),
best AS (
    SELECT host, path, arg_max(domain || start, length(domain || start)) AS rule,
           arg_max(verdict, length(domain || start)) AS verdict
    FROM (SELECT DISTINCT host, path FROM rows)
    JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
    GROUP BY host, path
)
SELECT r.page_id, r.host, r.path, b.rule,
       coalesce(b.verdict, CASE WHEN NOT p.allows THEN 'block' END, 'allow') AS verdict
FROM rows r
LEFT JOIN best b ON b.host = r.host AND b.path = r.path
LEFT JOIN passed p ON p.node = r.host || r.path || r.query
"""
