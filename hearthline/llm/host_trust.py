"""URL verdicts: fixed rules first, else trust and distrust spread over the host graph.

Trust starts at hosts that have pages allowed by a rule and follows links forward (personalised PageRank). Distrust
starts at hosts that have pages blocked by a rule and follows links backward: a host that links to blocked hosts is
suspect. Everything is DataFrame work; the graph has one row per pair of hosts, and each step is a partial
aggregate, so a host with a third of all pages or links is folded before anything is shuffled. Both are followed to the
ends of all paths and compared by relative difference, so a verdict does not depend on how much else the table holds.

Defined results: a null url or one without "://" has an empty host and path, no rule, and the verdict of a host that
nothing is known of (allow). A null html has no links. Repeated pages count as often as they stand. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import columns_only, materialise

#: Fixed values of the query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of anchors to other sites: an absolute or scheme-relative href.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
#: Steps of the SQL counterpart, which has no loop that ends by itself.
STEPS = 12
#: What a host has yet to pass on counts as nothing below this share of what it has passed on.
TOLERANCE = 1e-12
#: A host is blocked if its distrust exceeds this multiple of its trust by more than the margin, a share of it.
RATIO = 1.0
MARGIN = 1e-9


def url_host(url: Column) -> Column:
    """From the first "://" up to "/", "?", "#" or the end; A-Z in lower case; empty without "://"."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda x: (len(x[0] + x[1]), x[0] + x[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the anchors of each page."""
    targets = F.explode(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    pairs = pages.where(F.col("host") != "").select(F.col("host").alias("src"), targets.alias("dst")).where("dst <> src")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several kinds at once: `seeds` are (kind, host, mass), one in sum for each kind, `links`
    are (kind, src, dst, links). Mass at hosts without links returns to the seeds; as that only scales all masses of a
    kind, mass is passed on without it and divided by its sum at the end.

    `rest` is what a host has received and not yet passed on. A step passes on each rest above `tolerance` of the mass that
    went through the same host before, so a first arrival always goes on, however small and however far from a seed. Steps
    end when no such rest is left: at the ends of all paths, or when circles have died down, about 160 steps later. A step
    is one join and one sum over rows of a kind and host, and is written, so that lineage stays one step long."""
    seeds = materialise(seeds)
    if links.isEmpty():
        return seeds  # all mass returns to the seeds at each step
    out = links.groupBy("kind", "src").agg(F.sum("links").alias("total"))
    edges = materialise(links.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("total") * damping).alias("share")))
    mass, goes = seeds.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("rest")), F.col("rest") > F.col("mass") * tolerance
    while not (active := mass.where(goes)).isEmpty():
        moved = active.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("mass"), (F.col("rest") * F.col("share")).alias("rest"))
        stays = mass.select("kind", "host", (F.col("mass") + F.when(goes, F.col("rest")).otherwise(0.0)).alias("mass"), F.when(goes, 0.0).otherwise(F.col("rest")).alias("rest"))
        mass = materialise(stays.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("rest").alias("rest")))
    total = mass.groupBy("kind").agg(F.sum(F.col("mass") + F.col("rest")).alias("total"))
    return mass.join(total, "kind").select("kind", "host", ((F.col("mass") + F.col("rest")) / F.col("total")).alias("mass"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each page: the longest rule's verdict, else the host's."""
    pages = columns_only(pages, "page_id", "url", "html").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.withColumn("rule", rule).withColumn("says", says)
    seeds = materialise(judged.where("host <> '' and says is not null").groupBy("host").agg(F.count_if(F.col("says") == "allow").alias("good"), F.count_if(F.col("says") == "block").alias("bad")))
    totals = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    links = materialise(host_links(judged))
    starts = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("host"), (F.col(kind) / F.lit(max(totals[kind], 1))).alias("mass")) for kind in ("good", "bad")]))
    both = links.select(F.lit("good").alias("kind"), "src", "dst", "links").unionByName(links.select(F.lit("bad").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    mass = spread(both, seeds.select(starts.alias("s")).select("s.*").where("mass > 0"), damping)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    hosts = mass.groupBy("host").agg(of("good").alias("trust"), of("bad").alias("distrust"))
    known = judged.select("page_id", "host", "path", "rule", "says").join(hosts, "host", "left")
    suspect = F.coalesce(F.col("distrust") > F.col("trust") * (ratio * (1 + MARGIN)), F.lit(False))
    verdict = F.coalesce("says", F.when(suspect, F.lit("block")).otherwise(F.lit("allow")))
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def _spread_sql(name: str, src: str, dst: str, kind: str, steps: int, damping: float) -> str:
    parts = [
        f"{name}_out AS (SELECT {src} AS src, sum(links) AS total FROM links GROUP BY 1)",
        f"{name}_seed AS (SELECT host, {kind}::DOUBLE / (SELECT sum({kind}) FROM seeds) AS mass FROM seeds WHERE {kind} > 0)",
        f"{name}_0 AS (SELECT host, mass FROM {name}_seed)",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"{name}_{k} AS (SELECT host, sum(mass) AS mass FROM (SELECT l.{dst} AS host, m.mass * l.links / o.total * {damping} AS mass FROM {name}_{k - 1} m "
            f"JOIN links l ON l.{src} = m.host JOIN {name}_out o ON o.src = m.host UNION ALL SELECT host, mass * ({1 - damping} + {damping} * "
            f"(SELECT coalesce(sum(mass), 0) FROM {name}_{k - 1} WHERE host NOT IN (SELECT src FROM {name}_out))) FROM {name}_seed) GROUP BY 1)"
        )
    return ", ".join(parts)


def oracle(steps: int = STEPS, damping: float = DAMPING) -> str:
    """Spells the rules on its own, longest first."""
    under = lambda host: f"(host = '{host}' OR ends_with(host, '.{host}'))"
    rule = f"""CASE WHEN {under("example.org")} AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN {under("example.org")} AND starts_with(path, '/en/1') THEN 'example.org/en/1'
 WHEN {under("com")} AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN {under("com")} AND starts_with(path, '/de/') THEN 'com/de/' WHEN {under("org")} AND starts_with(path, '/') THEN 'org/' END"""
    link = LINK.removeprefix("(?i)").replace("'", "''")
    return f"""
WITH cut AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule FROM cut),
judged AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says FROM ruled),
seeds AS (SELECT host, count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad FROM judged WHERE host <> '' AND says IS NOT NULL GROUP BY 1),
links AS (SELECT src, dst, count(*) AS links FROM (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'i')), '{UPPER}', '{LOWER}') AS dst
 FROM judged WHERE host <> '') WHERE src <> dst GROUP BY 1, 2),
{_spread_sql("t", "src", "dst", "good", steps, damping)}, {_spread_sql("d", "dst", "src", "bad", steps, damping)}
SELECT page_id, j.host, path, rule, coalesce(says, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) * {1 + MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN t_{steps} t ON t.host = j.host LEFT JOIN d_{steps} d ON d.host = j.host"""
