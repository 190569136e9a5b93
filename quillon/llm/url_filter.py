"""URL filters: rules first, then trust and distrust spread over the link graph of hosts.

Rules (host, path, verdict) fit a host and its subdomains where the url's path begins with the
rule's; the longest rule wins. Pages under rules seed two personalised PageRanks over host
edges: trust starts at hosts with allowed pages and follows links; distrust starts at hosts with
blocked pages and runs against them (who links to bad hosts is suspect). A host whose distrust
exceeds both its trust and a share of the even spread is blocked; other hosts are allowed.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless its (empty) host is blocked, which never is seeded; a null html has no links; relative links
are links of a host to itself; repeated rows count each; very long pages are read whole; an empty table gives an empty result.
Other columns pass through, whatever they are named, but for those that are added, which replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, read, save

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add host, path, rule and rule_verdict. Rules are few and fixed, so they are one expression and no join."""
    known = pages.withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return known.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, counted before and after the shuffle alike."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    ends = F.array_distinct(F.transform(links, lambda x: F.when(x.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//"), host_of(F.regexp_replace(x, r"^//", "http://"))).otherwise(F.col("host"))))
    return pages.select(F.col("host").alias("src"), F.explode(ends).alias("dst")).where("src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = 15, damping: float = 0.85) -> DataFrame:
    """(kind, host, mass): a personalised PageRank for each kind over (kind, src, dst, share) from seeds (kind, host, seed)."""
    ranks = seeds.select("kind", "host", F.col("seed").alias("mass"))
    for k in range(rounds):
        moved = ranks.join(edges.withColumnRenamed("src", "host"), ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        ranks = moved.unionAll(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % 5 == 4:
            ranks = save(ranks, "ranks")
    return ranks


def judge_hosts(known: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(host, trust, distrust, host_verdict), one row per host with a page or a link."""
    found = save(host_edges(known), "edges")
    pages = known.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    hosts = save(pages.select("host", "allowed", "blocked").unionByName(found.select(F.col("dst").alias("host"), F.lit(0).alias("allowed"), F.lit(0).alias("blocked"))).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "hosts")
    n, allowed, blocked = hosts.agg(F.count("*"), F.sum("allowed"), F.sum("blocked")).first()
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / float(max(allowed or 0, 1))).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") / float(max(blocked or 0, 1))).alias("seed")))).alias("s")).select("s.kind", "host", "s.seed").where("seed > 0")
    ways = found.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(found.select(F.lit("distrust"), "dst", "src", "n"))
    total = ways.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = ways.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share"))
    # A host without links keeps what it has.
    stay = hosts.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), F.col("host").alias("src")).join(total, ["kind", "src"], "left_anti").select("kind", "src", F.col("src").alias("dst"), F.lit(1.0).alias("share"))
    ranks = spread(save(shares.unionAll(stay), "shares"), save(seeds, "seeds"))
    mass = ranks.groupBy("host").agg(F.round(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0.0)), 12).alias("trust"), F.round(F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0.0)), 12).alias("distrust"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * float(max(n, 1)) > threshold)
    return save(mass.withColumn("host_verdict", F.when(bad, "block").otherwise("allow")), "judged")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages' columns with host, path, rule, verdict, trust and distrust; columns of pages of these names are replaced."""
    inner = ruled(pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"), F.col("url"), F.col("html")), rules)
    hosts = judge_hosts(inner.select("host", "rule_verdict", "html"))
    found = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("rule_verdict", "host_verdict", F.lit("allow")), "trust": F.col("trust"), "distrust": F.col("distrust")}
    return inner.join(hosts, "host", "left").select(*[F.col(f"page.`{c}`").alias(c) for c in pages.columns if c not in found], *[v.alias(k) for k, v in found.items()])


def op8_url_filter(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql(rounds: int = 15) -> str:
    """The rules, and the two ranks round by round, as DuckDB SQL."""
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}')"
    by_length = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in by_length) + " END"
    steps = "".join(
        f""", r{k} AS (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT r.kind, s.dst AS host, r.mass * s.share * 0.85 AS mass FROM r{k - 1} r JOIN shares s ON r.kind = s.kind AND r.host = s.src
    UNION ALL SELECT kind, host, seed * (1 - 0.85) FROM seeds) GROUP BY kind, host
)"""
        for k in range(1, rounds + 1)
    )
    return rf"""
WITH known AS (
  SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ruled AS (
  SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM known
), links AS (
  SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM ruled
), ends AS (
  SELECT DISTINCT page_id, host AS src, CASE WHEN regexp_matches(link, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//') THEN {host("regexp_replace(link, '^//', 'http://')")} ELSE host END AS dst FROM links
), found AS (
  SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND dst <> '' GROUP BY src, dst
), hosts AS (
  SELECT host, sum(a) AS allowed, sum(b) AS blocked FROM (
    SELECT host, (said IS NOT DISTINCT FROM 'allow')::INT AS a, (said IS NOT DISTINCT FROM 'block')::INT AS b FROM ruled WHERE host <> '' UNION ALL SELECT dst, 0, 0 FROM found) GROUP BY host
), totals AS (
  SELECT count(*) AS n, greatest(sum(allowed), 1) AS allowed, greatest(sum(blocked), 1) AS blocked FROM hosts
), seeds AS (
  SELECT 'trust' AS kind, host, h.allowed::DOUBLE / t.allowed::DOUBLE AS seed FROM hosts h, totals t WHERE h.allowed > 0
  UNION ALL SELECT 'distrust', host, h.blocked::DOUBLE / t.blocked::DOUBLE FROM hosts h, totals t WHERE h.blocked > 0
), ways AS (
  SELECT 'trust' AS kind, src, dst, n FROM found UNION ALL SELECT 'distrust', dst, src, n FROM found
), shares AS (
  SELECT kind, src, dst, n::DOUBLE / (sum(n) OVER (PARTITION BY kind, src))::DOUBLE AS share FROM ways
  UNION ALL SELECT k.kind, host, host, 1.0 FROM hosts, (VALUES ('trust'), ('distrust')) k(kind) WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.kind = k.kind AND w.src = host)
), r0 AS (
  SELECT kind, host, seed AS mass FROM seeds
){steps}, judged AS (
  SELECT host, round(coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0), 12) AS trust, round(coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0), 12) AS distrust FROM r{rounds} GROUP BY host
)
SELECT page_id, ruled.host, path, rule, coalesce(said, CASE WHEN distrust > trust AND distrust * (SELECT greatest(n, 1) FROM totals) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN judged ON ruled.host = judged.host
"""


OP8_SQL = _sql()
