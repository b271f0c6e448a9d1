"""URL filters with redirect equivalence, with DataFrame functions only.

A URL is judged by the longest rule that fits its host and path.  A URL that no
rule fits takes the decision of its aliases: URLs joined by redirects, canonical
links or by being forms of one address (another scheme, fragment, tracking
parameter or final slash) make a connected component, and one blocked URL blocks
the component's undecided ones.  An explicit allow stands whatever its aliases say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelearn.llm.components import components
from tidelearn.llm.registry import register, table
from tidelearn.session import materialize

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Query parameters that do not change the page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def lower_az(c: Column) -> Column:
    """A-Z made lower case, other letters left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(lower_az(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null; of equally long ones an allow wins."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def address(url: Column) -> Column:
    """The form shared by equal addresses: lower-case host and path without scheme, fragment, tracking parameters or a final slash."""
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(query, rf"(?<=^|&)(?:{TRACKING})=[^&]*(?:&|$)", "")
    kept = F.regexp_replace(kept, r"&$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(url.contains("://"), F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Redirect and canonical-link edges (url, target) that pages state in their head."""
    head = F.substring_index(F.col(html), "<body", 1)
    canonical = F.regexp_extract_all(head, F.lit(r"(?i)<link\s[^>]*?rel=[\"']?canonical[\"']?[^>]*?href=[\"']?([^\"' >]+)"), F.lit(1))
    turned = F.regexp_extract_all(head, F.lit(r"(?i)<link\s[^>]*?href=[\"']?([^\"' >]+)[\"']?[^>]*?rel=[\"']?canonical"), F.lit(1))
    refresh = F.regexp_extract_all(head, F.lit(r"(?i)<meta\s[^>]*?http-equiv=[\"']?refresh[\"']?[^>]*?url=([^\"' >]+)"), F.lit(1))
    return (
        pages.where(F.col(html).rlike("(?i)canonical|http-equiv"))
        .select(F.col(url).alias("url"), F.explode(F.concat(canonical, turned, refresh)).alias("target"))
        .where("url is not null and target like '%://%'")
    )


def judge(urls: DataFrame, links: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict; ``links`` holds further alias edges (url, target).

    URLs and link targets of one address are one node.  Links are edges between addresses;
    only addresses with a link to another enter the component search.  A node is blocked if
    the rules block one of its URLs, or one of its component's: rules judge link targets
    that are no rows too.  An explicit rule of a URL stands.  Without a rule the verdict is
    block where the component is blocked, else allow.

    Null URLs and those without ``://`` have empty host and path, no address and the verdict allow.
    Repeated rows are judged alike; an empty table gives no rows.  Columns of
    ``urls`` named host, path, rule or verdict are replaced; every other one is kept.
    """
    here = F.col(url)
    rows = urls.withColumns({"host": host_of(here), "path": path_of(here)})
    rows = rows.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"rule": F.col("__best.rule"), "__own": F.col("__best.verdict"), "__address": address(here)}).drop("__best")

    def decisions(d: DataFrame, c: str) -> DataFrame:
        best = best_rule(host_of(F.col(c)), path_of(F.col(c)), rules)
        return d.select(address(F.col(c)).alias("address"), (best.verdict == "block").alias("blocked")).where("address is not null and blocked")

    blocked = decisions(urls, url)
    if links is not None:
        blocked = blocked.union(decisions(links, "target"))
    blocked = blocked.select("address").distinct()
    if links is not None:
        edges = materialize(links.select(address(F.col("url")).alias("a"), address(F.col("target")).alias("b")).where("a <> b").distinct(), "url-links")
        if not edges.isEmpty():
            groups = components(edges)
            bad = groups.join(blocked.withColumnRenamed("address", "node"), "node").select("component").distinct()
            blocked = blocked.union(groups.join(bad, "component").select(F.col("node").alias("address"))).distinct()
    # Only rows that no rule decides look for a blocked alias; the others get keys
    # that no address has, all different, so that they spread over the tasks.
    blocked = blocked.select(F.col("address").alias("__blocked"))
    apart = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("__address", F.coalesce(F.when(F.col("__own").isNull(), F.col("__address")), apart))
    rows = rows.join(blocked, F.col("__address") == F.col("__blocked"), "left")
    verdict = F.coalesce(F.col("__own"), F.when(F.col("__blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.withColumn("verdict", verdict).drop("__own", "__address", "__blocked")


@register(
    "op4_urls",
    """
WITH parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*[?]([^#]*)', 1), ''), '(^|&)((utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$))+', '\\1', 'g'), '&$', '') AS kept
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT a.*, b.rule, b.verdict AS own, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '/+$', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS address
  FROM parts a LEFT JOIN LATERAL (
    SELECT h || p AS rule, verdict FROM rules WHERE (a.host = h OR ends_with(a.host, '.' || h)) AND starts_with(a.path, p)
    ORDER BY length(h || p) DESC, verdict LIMIT 1) b ON true),
blocked AS (SELECT DISTINCT address FROM ruled WHERE own = 'block')
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN address IN (SELECT address FROM blocked WHERE address IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
""",
)
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls; links are those that the pages state.  The SQL leaves links out: the given pages state none."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), page_links(pages)).select("page_id", "host", "path", "rule", "verdict")
