"""URL rules, and verdicts for all other hosts by propagating trust and distrust over the graph of hosts.

Rules name a host and the start of a path. A rule fits its host and all hosts below it; of those that fit, the longest decides. Pages
that no rule decides get the verdict of their host: personalised PageRank carries trust from hosts with allowed pages along the links,
and distrust from hosts with blocked pages against them (who links to blocked hosts is distrusted). A host's seed is its number of
allowed or of blocked pages, so that both ranks are on one scale. A host is blocked where more than ``threshold`` per cent of
trust and distrust together is distrust.

An edge leads from a page's host to the host of each absolute or protocol-relative link in its html, weighted by the number of such links,
and from each host to the domain above it and back (two labels at least, weight ``kin``): a domain answers for the hosts below it.
Links to the same host say nothing and are left out.

Ranks are whole numbers of 1/1,000,000 of a page and every division rounds down, so results don't depend on the order of sums and SQL gives the
same. What reaches a host without links out ends there; giving it back to the seeds would scale all ranks of one kind alike.

Everything is DataFrame work. Pages are read once for rules and links; arcs and ranks are as large as the graph of hosts, pages and links are
summed by host before they are shuffled, and a rank is joined to arcs by a shuffle that adaptive execution splits where one host has most of
them. Lineage is cut every ``EVERY`` rounds by a table in the shared folder; inside these rounds the shuffle of the arcs is reused.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, is no node of the graph and is allowed; so is a host that
neither trust nor distrust reaches. Null html has no links. Repeated rows count as often as they occur. Ports and user names are part of the
host. An empty table gives an empty result. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import discard, join_hot, stage

#: Host, start of the path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UNIT, EVERY, MAX_RULES = 1_000_000, 5, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict. Of equally long ones the first listed decides."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last one is asked first
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def linked_hosts(html: Column) -> Column:
    """The hosts of all absolute and protocol-relative links, repeats included."""
    return F.regexp_extract_all(F.translate(F.coalesce(html, F.lit("")), UPPER, LOWER), F.lit(LINK), F.lit(1))


def host_edges(pages: DataFrame, host: str, links: str, kin: int) -> DataFrame:
    """src, dst, w: links between hosts, summed, and each host with the domains above it. pages: a host and its array of linked hosts a row."""
    found = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(links).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    known = pages.select(F.col(host).alias("h")).distinct().union(found.select("dst")).where("h != ''").distinct()
    labels = F.split("h", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = known.select(F.explode(F.arrays_zip(above.alias("lower"), F.slice(above, 2, 1 << 20).alias("upper"))).alias("p")).where("p.upper is not null").select("p.lower", "p.upper").distinct()
    both = pairs.select(F.col("lower").alias("src"), F.col("upper").alias("dst")).union(pairs.select("upper", "lower"))
    return found.union(both.select("src", "dst", F.lit(kin).cast("long"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 20, damping: int = 85) -> DataFrame:
    """host, trust, distrust: ranks after so many rounds, in units of 1/1,000,000. edges: src, dst, w, staged; seeds: host, allowed, blocked,
    one row a host."""
    arcs = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").union(edges.select(F.lit(1), "dst", "src", "w"))
    total = arcs.groupBy("kind", "host").agg(F.sum("w").alias("total"))
    arcs = stage(arcs.join(total, ["kind", "host"]), "arcs")
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("allowed").alias("n")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("n"))))
    seed = stage(seeds.select("host", both.alias("s")).where("s.n > 0").select("s.kind", "host", (F.col("s.n") * UNIT).alias("rank")), "seed")
    given = seed.select("kind", "host", F.expr(f"rank * {100 - damping} div 100").alias("rank"))
    rank, last = seed, None
    for i in range(1, rounds + 1):
        share = F.expr(f"(cast(rank as decimal(20, 0)) * {damping} * w) div (cast(total as decimal(20, 0)) * 100)")
        passed = rank.join(arcs, ["kind", "host"]).select("kind", F.col("to").alias("host"), share.alias("rank"))
        rank = passed.union(given).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % EVERY == 0 or i == rounds:
            rank = stage(rank, "rank")
            if last is not None:
                discard(last)
            last = rank
    mine = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0))
    return rank.groupBy("host").agg(mine(0).alias("trust"), mine(1).alias("distrust"))


def judge(pages: DataFrame, page: str, url: str, html: str, rules=RULES, rounds: int = 20, damping: int = 85, threshold: int = 50, kin: int = 1) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page; the last two are its host's ranks."""
    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    rule, said = fitting(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(f"`{page}`").alias("page_id"), host.alias("host"), path.alias("path"), linked_hosts(F.col(f"`{html}`")).alias("links"))
    rows = stage(rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), "links"), "pages")
    edges = stage(host_edges(rows, "host", "links", kin), "edges")
    count = lambda what: F.count(F.when(F.col("said") == what, 1))
    hosts = rows.where("host != ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"), F.count(F.lit(1)).alias("n"))
    hosts = stage(hosts, "hosts")
    ranks = propagate(edges, hosts, rounds, damping)
    scored = stage(hosts.select("host", "n").join(ranks, "host", "left").na.fill(0, ["trust", "distrust"]), "ranks")
    out = join_hot(rows.drop("links"), scored, ["host"], "left").na.fill(0, ["trust", "distrust"])
    bad = F.col("distrust") * 100 > (F.col("trust") + F.col("distrust")) * threshold
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    """The rule and the verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")


def _fits(domain: str, start: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}')"


def _cases(value) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_fits(d, s)} THEN '{value(d, s, says)}'" for d, s, says in longest) + " END"


def _rounds(rounds: int = 20, damping: int = 85) -> str:
    step = """r{i} AS MATERIALIZED (
  SELECT kind, host, sum(rank)::HUGEINT AS rank FROM (
    SELECT a.kind, a."to" AS host, (r.rank * {d} * a.w) // (a.total * 100) AS rank FROM r{b} r JOIN arcs a ON a.kind = r.kind AND a.host = r.host
    UNION ALL SELECT kind, host, rank * {e} // 100 FROM r0) GROUP BY kind, host
)"""
    return ",\n".join(step.format(i=i, b=i - 1, d=damping, e=100 - damping) for i in range(1, rounds + 1))


OP12_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, html FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, html FROM u
), p AS MATERIALIZED (
  SELECT page_id, host, path, html, {_cases(lambda d, s, says: d + s)} AS rule, {_cases(lambda d, s, says: says)} AS said FROM h
), links AS MATERIALIZED (
  SELECT src, dst, count(*) AS w FROM (
    SELECT host AS src, unnest(regexp_extract_all(translate(coalesce(html, ''), '{UPPER}', '{LOWER}'), '{LINK.replace("'", "''")}', 1)) AS dst FROM p WHERE host <> '')
  WHERE src <> dst GROUP BY src, dst
), known AS (
  SELECT host AS h FROM p WHERE host <> '' UNION SELECT dst FROM links
), parts AS (
  SELECT string_split(h, '.') AS l FROM known
), chain AS (
  SELECT DISTINCT array_to_string(l[i:], '.') AS lo, array_to_string(l[i + 1:], '.') AS up FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM parts)
), edges AS (
  SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT lo, up, 1 FROM chain UNION ALL SELECT up, lo, 1 FROM chain) GROUP BY src, dst
), arcs AS MATERIALIZED (
  SELECT *, sum(w) OVER (PARTITION BY kind, host) AS total
  FROM (SELECT 0 AS kind, src AS host, dst AS "to", w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges)
), r0 AS MATERIALIZED (
  SELECT CASE WHEN said = 'allow' THEN 0 ELSE 1 END AS kind, host, (count(*) * {UNIT})::HUGEINT AS rank FROM p WHERE host <> '' AND said IS NOT NULL GROUP BY 1, 2
), {_rounds()}
, ranks AS (
  SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 0), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 1), 0) AS distrust FROM r20 GROUP BY host
)
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN distrust * 100 > (trust + distrust) * 50 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM p LEFT JOIN ranks ON ranks.host = p.host
"""
