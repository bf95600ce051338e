"""Operator 5: URL filters by rules and link-graph propagation, in DataFrame functions only.

Rules decide the urls they fit. Other urls are judged by their host: trust flows along host
links from hosts with allowed urls (personalised PageRank), distrust flows against the links
from hosts with blocked urls, and a host is blocked if its distrust exceeds THRESHOLD times
its trust. Masses are whole numbers (UNITS in all, rounded down at each step), so sums don't
depend on their order and reruns agree to the bit.

Host edges are the links between pages of different hosts and, both ways and once each, those between a
host and the domain above it (a.b.c and b.c; names of one label have no part), which the two have in common
with their owner.

Pages are aggregated to hosts and links to (source, target, count) before any iteration, so
a host with a third of all pages is one row there; verdicts of hosts are broadcast if they are few.

Nulls: a null url, or one without `://`, has empty host and path, fits no rule and is judged
as the empty host; null html has no links. Repeated rows count as often as they occur. With
no seeds of a kind there is no mass of that kind. Hosts of more than HOST_LENGTH characters, which no
name server has, get no domain edges; urls of any length are parsed whole. Only page_id, url and html are
read, so other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small, table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ROUNDS = 12
#: Follow a link with 85 %, else restart at the seeds.
FOLLOW = 85
UNITS = 10**12
THRESHOLD = 2
HOST_LENGTH = 253
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. pages: host, html."""
    to = F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1)))
    return pages.select(F.col("host").alias("src"), to.alias("to")).select("src", lower_ascii(F.col("to")).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, n = 1): both ways between each host and the domain above it. hosts: host."""
    labels = hosts.filter(F.length("host") <= HOST_LENGTH).select("host").distinct().withColumn("l", F.split("host", "\\.")).filter(F.size("l") > 2)
    above = lambda i: F.array_join(F.slice(F.col("l"), i, F.size("l")), ".")
    steps = labels.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(above(i).alias("a"), above(i + 1).alias("b")))).alias("e"))
    both = F.explode(F.array(F.struct(F.col("e.a").alias("src"), F.col("e.b").alias("dst")), F.struct(F.col("e.b").alias("src"), F.col("e.a").alias("dst"))))
    return steps.select(both.alias("x")).select("x.*").distinct().withColumn("n", F.lit(1).cast("long"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links and domain edges. pages: host, html."""
    return host_links(pages).unionByName(domain_links(pages)).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, follow: int = FOLLOW, units: int = UNITS) -> DataFrame:
    """(host, kind, mass). seeds: host, kind ('trust' or 'distrust'), weight > 0. Trust
    follows the links, distrust goes against them. The
    followed mass of a host without links of its kind restarts in proportion to the seeds."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    edges = saved(both.join(total, ["kind", "src"]))
    whole = seeds.groupBy("kind").agg(F.sum("weight").alias("all_weight"))
    start = saved(seeds.groupBy("host", "kind").agg(F.sum("weight").alias("weight")).join(whole, "kind").select("host", "kind", F.expr(f"cast(floor(cast({units} as decimal(38,0)) * weight / all_weight) as bigint)").alias("base")))
    mass = start.withColumnRenamed("base", "mass")
    if edges.isEmpty():
        return mass
    seeded = start.groupBy("kind").agg(F.sum("base").alias("seeded"))
    start = saved(start.join(F.broadcast(seeded), "kind"))  # one row per kind
    step_mass = F.expr(f"cast((cast(mass as decimal(38,0)) * {follow} * n) div (100 * out) as bigint)")
    for _ in range(rounds):
        # without links dst is null, so their mass meets in one row per kind
        step = mass.withColumnRenamed("host", "src").join(edges, ["src", "kind"], "left")
        flow = saved(step.groupBy(F.col("dst").alias("host"), "kind").agg(F.sum(F.when(F.col("dst").isNull(), F.col("mass")).otherwise(step_mass)).alias("mass")))
        lost = flow.filter("host is null").select("kind", F.col("mass").alias("lost"))
        again = F.expr(f"(base * {100 - follow}) div 100 + cast((cast(base as decimal(38,0)) * {follow} * coalesce(lost, 0)) div (100 * cast(greatest(seeded, 1) as decimal(38,0))) as bigint)")
        back = start.join(F.broadcast(lost), "kind", "left").select("host", "kind", again.alias("mass"))
        mass = flow.filter("host is not null").unionByName(back).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
    return mass


def judge_urls(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    ruled = parsed.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    kinds = F.when(F.col("r.verdict") == "allow", "trust").otherwise("distrust")
    seeds = ruled.filter(F.col("r").isNotNull()).groupBy("host", kinds.alias("kind")).agg(F.count("*").alias("weight"))
    mass = propagate(host_edges(parsed), seeds, rounds)
    by_host = mass.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0)).alias("distrust"),
    )
    blocked = saved(by_host.filter(f"distrust > {threshold} * trust").select("host", F.lit("block").alias("v")))
    out = ruled.drop("html").join(small(blocked), "host", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("v"), F.lit("allow")).alias("verdict"))


def op5_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    pick = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(v, h, p)}'" for v, h, p in rules) + " END"
    steps = []
    for i in range(ROUNDS):
        steps.append(
            f"m{i + 1} AS MATERIALIZED (SELECT host, kind, sum(mass)::BIGINT AS mass FROM ("
            f"SELECT e.dst AS host, e.kind, ((m.mass::HUGEINT * {FOLLOW} * e.n) // (100 * e.outs))::BIGINT AS mass FROM m{i} m JOIN e ON m.host = e.src AND m.kind = e.kind "
            f"UNION ALL SELECT host, z.kind, ((mass * {100 - FOLLOW}) // 100 + (mass::HUGEINT * {FOLLOW} * coalesce(lost, 0)) // (100 * greatest(seeded, 1)))::BIGINT FROM z "
            f"LEFT JOIN (SELECT m.kind, sum(m.mass) AS lost FROM m{i} m ANTI JOIN e ON m.host = e.src AND m.kind = e.kind GROUP BY 1) l ON z.kind = l.kind) GROUP BY 1, 2)"
        )
    href = HREF.replace("'", "''")
    return f"""
WITH p AS (SELECT page_id, html,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {pick(lambda v, h, p: h + p)} AS rule, {pick(lambda v, h, p: v)} AS ruled FROM p),
d AS (SELECT string_split(host, '.') AS d FROM (SELECT DISTINCT host FROM p WHERE length(host) <= {HOST_LENGTH})),
u AS (SELECT DISTINCT array_to_string(d[i:], '.') AS a, array_to_string(d[i + 1:], '.') AS b FROM (SELECT d, unnest(range(1, len(d) - 1)) AS i FROM d)),
l AS (SELECT src, dst, sum(n) AS n FROM (
  SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p) WHERE src <> dst GROUP BY 1, 2
  UNION ALL SELECT a, b, 1 FROM u UNION ALL SELECT b, a, 1 FROM u) GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
e AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY kind, src) AS outs FROM b),
s AS (SELECT host, CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS weight FROM r WHERE rule IS NOT NULL GROUP BY 1, 2),
m0 AS MATERIALIZED (SELECT host, kind, (({UNITS}::HUGEINT * weight) // sum(weight) OVER (PARTITION BY kind))::BIGINT AS mass FROM s),
z AS MATERIALIZED (SELECT *, sum(mass) OVER (PARTITION BY kind) AS seeded FROM m0),
{", ".join(steps)},
f AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM (SELECT * FROM m{ROUNDS} WHERE EXISTS (FROM e) UNION ALL SELECT * FROM m0 WHERE NOT EXISTS (FROM e)) GROUP BY 1)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN f.distrust > {THRESHOLD} * f.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN f ON r.host = f.host
"""


OP5_SQL = _sql()
