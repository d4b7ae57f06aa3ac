"""URL filters: host and path rules first, then trust and distrust spread over the links between hosts."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import prepare, store, table

#: (verdict, host, path); a rule holds for its host and all subdomains, where the url's path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Scores are whole multiples of 1 / SCALE, so that sums do not depend on the order of rows.
SCALE = 10 ** 9
#: Percent of a host's score that goes on to its neighbours in a round.
DAMPING = 85
#: Rounds of propagation; what later rounds would add is below 0.85 ** 24, or 2 %, of the seeds' scores.
ROUNDS = 24
#: Percent by which distrust must exceed trust; a host without links reaches it when the rules block so much more of its pages than they allow.
THRESHOLD = 50

URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of an absolute or protocol-relative link.
LINK = "[hH][rR][eE][fF][ \\t\\n\\f\\r]{0,8}=[ \\t\\n\\f\\r]{0,8}[\"']?[ \\t\\n\\f\\r]{0,8}(?:[hH][tT][tT][pP][sS]?:)?//([^/?#\"'<> \\t\\n\\f\\r]+)"


def ascii_lower(text):
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url):
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, null where none does; equally long ones in code-point order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): pages of host ``src`` with an href to host ``dst``, each page counted once; no link to itself."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(LINK), 1), ascii_lower))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), links.alias("links")).where("size(links) > 0 AND src <> ''")
    return (rows.select("src", F.explode("links").alias("dst")).where("src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: (host, score) from (host, score) of the seeds over edges (src, dst, weight, total).

    Every round passes on what the last one brought, ``DAMPING`` percent of it in proportion to
    the weights, so the sum over rounds is the rank; it ends when nothing is left to pass on.  The
    join's key is a host: contributions to a host are summed on the map side, and a host of very
    many links is left to the adaptive split of skewed joins.
    """
    fresh = store(seeds.where("score > 0"))
    parts = [fresh]
    share = F.expr(f"(cast(score AS decimal(19,0)) * cast({DAMPING} * weight AS decimal(17,0))) div cast(100 * total AS decimal(19,0))")
    for _ in range(rounds):
        fresh = store(fresh.join(edges, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), share.alias("score"))
                      .groupBy("host").agg(F.sum("score").alias("score")).where("score > 0"))
        if fresh.isEmpty():
            break
        parts.append(fresh)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("host").agg(F.sum("score").alias("score"))


def judge_hosts(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, trust, distrust, blocked): one row per host that a rule or a link touches.

    A host's seed of trust is the share of its pages that the rules allow, its seed of distrust
    the share that they block.  Trust follows the links; distrust goes against them, to the hosts
    that link to a distrusted one.  ``blocked`` is set where distrust exceeds trust by
    ``THRESHOLD`` percent of the greatest seed.
    """
    url = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).where("host <> ''")
    ruled = url.select("host", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("v"))
    counts = store(ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad")))
    links = store(host_links(pages, url_col, html_col))
    out_of = links.groupBy("src").agg(F.sum("weight").alias("total"))
    into = links.groupBy("dst").agg(F.sum("weight").alias("total"))
    forth = store(links.join(out_of, "src").select("src", "dst", "weight", "total"))
    back = store(links.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "total"))
    seed = lambda c: F.expr(f"({(100 - DAMPING) * SCALE // 100} * {c}) div n").alias("score")
    trust = spread(counts.select("host", seed("good")), forth).withColumnRenamed("score", "trust")
    distrust = spread(counts.select("host", seed("bad")), back).withColumnRenamed("score", "distrust")
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") - F.col("trust") >= (100 - DAMPING) * SCALE // 100 * THRESHOLD // 100)


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest fitting rule decides; without one, the verdict is that of the page's host by
    ``judge_hosts``: block where it is blocked, else allow.  A null url, or one without ``://``,
    has an empty host and path, fits no rule and is allowed.  A null or empty html has no links.
    Ids may be null or repeat; every row is judged, and counts, for itself.  Other columns are
    not read.  ``rules`` is a list that becomes one expression: a parameter, not a table.
    """
    prepare(pages.sparkSession)
    blocked = store(judge_hosts(pages, rules, url_col, html_col).where("blocked").select(F.col("host").alias("__host"), "blocked"))
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    # a ruled page needs no host's verdict: its key is null, and it stays where it is
    asks = F.when(F.col("__rule").isNull(), F.col("host"))
    judged = rows.withColumn("__ask", asks).join(blocked, F.col("__ask") == F.col("__host"), "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_Q = "''"
OP13_SQL = f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
c AS (
  SELECT host, count(*) AS n, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS good,
         count(*) FILTER (rule IN ('example.com/de/', 'net/')) AS bad FROM r WHERE host <> '' GROUP BY host),
p AS (SELECT row_number() OVER () AS id, host, list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", _Q)}', 1),
             lambda x: translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}'))) AS links FROM u WHERE host <> ''),
l AS (SELECT src, dst, count(*) AS weight FROM (SELECT host AS src, unnest(links) AS dst FROM p) WHERE src <> dst GROUP BY ALL),
f AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS total FROM l),
b AS (SELECT dst AS src, src AS dst, weight, sum(weight) OVER (PARTITION BY dst) AS total FROM l),
t(host, score, round) AS (
  SELECT host, (150000000 * good // n)::BIGINT, 0 FROM c WHERE good > 0
  UNION ALL
  SELECT f.dst, sum(t.score::HUGEINT * 85 * f.weight::HUGEINT // (100 * f.total))::BIGINT AS s, max(round) + 1 FROM t JOIN f ON t.host = f.src
  WHERE round < 24 GROUP BY f.dst HAVING s > 0),
d(host, score, round) AS (
  SELECT host, (150000000 * bad // n)::BIGINT, 0 FROM c WHERE bad > 0
  UNION ALL
  SELECT b.dst, sum(d.score::HUGEINT * 85 * b.weight::HUGEINT // (100 * b.total))::BIGINT AS s, max(round) + 1 FROM d JOIN b ON d.host = b.src
  WHERE round < 24 GROUP BY b.dst HAVING s > 0),
v AS (
  SELECT host FROM (SELECT host, -score AS s FROM t UNION ALL SELECT host, score FROM d) GROUP BY host HAVING sum(s) >= 75000000)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host IN (SELECT host FROM v) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
