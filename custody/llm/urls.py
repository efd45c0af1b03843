"""URL rules and link-graph propagation, in DataFrame and SQL functions only.

A page is judged by the longest rule that fits its url, else by its host. Hosts get two
personalised ranks over the links between hosts: trust flows from hosts with allowed pages
along links, distrust from hosts with blocked pages against them (who links to a bad host is
suspect). A host is blocked if distrust makes up more than ``threshold`` of the two.

Links are the absolute and protocol-relative addresses in the pages' markup, weighted by
their number, and one link each way between a host and its parent domain where both have
pages. Mass that reaches a host without links ends there; the number of rounds is fixed.

Defined cases: a null url or one without ``://`` has an empty host and path, takes no part in
the graph and is allowed unless a rule fits; a null page has no links; a host without either
rank is allowed. Repeated rows are judged alike and count twice as seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.llm.work import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
_WRITE_EVERY = 5

Rule = tuple[str, str, str]  # host, path, allow or block


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def by_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest fitting rule; of equally long ones a block wins."""

    def choose(values) -> Column:
        found = F.lit(None).cast("string")
        # built from the shortest on, so that the longest is asked first
        for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r)):
            fits = (F.concat(F.lit("."), host).endswith(f".{rule[0]}")) & path.startswith(rule[1])
            found = F.when(fits, F.lit(values(rule))).otherwise(found)
        return found

    return choose(lambda r: r[0] + r[1]), choose(lambda r: r[2])


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, ruled)."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = by_rule(rules, F.col("host"), F.col("path"))
    return cut.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    linked = pages.where(F.col("html").isNotNull()).select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")
    )
    linked = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    parents = hosts.select(
        F.col("host").alias("child"),
        F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, 1000), "."))).alias("host"),
    ).where("host <> ''").join(hosts, "host", "left_semi")
    kin = parents.select(F.explode(F.array(F.struct(F.col("child").alias("src"), F.col("host").alias("dst")), F.struct(F.col("host").alias("src"), F.col("child").alias("dst")))).alias("e"))
    both = linked.union(kin.select("e.src", "e.dst")).where("src <> dst and src <> ''")
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust); seeds (host, kind, seed), where kind is 't' or 'd' and each kind sums to 1.

    Trust arcs follow the links, distrust arcs turn them round; each leaves its start with
    its share of the weight there, so both ranks move in one join and one aggregate a round.
    """
    arcs = links.select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").union(
        links.select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight")
    )
    total = arcs.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    arcs = written(arcs.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("total")).alias("share")), "arcs")
    start = written(seeds.select("host", "kind", (F.lit(1 - damping) * F.col("seed")).alias("rank")), "seeds")
    rank = seeds.select("host", "kind", F.col("seed").alias("rank"))
    for i in range(1, rounds + 1):
        moved = rank.join(arcs, ["kind", "host"]).select(F.col("to").alias("host"), "kind", (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
        rank = moved.union(start).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
        if i % _WRITE_EVERY == 0:
            rank = written(rank, "rank")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust); the ranks are those of the host, null without any."""
    found = judged(pages, rules)
    counts = found.where("host <> '' and ruled is not null").groupBy("host", F.when(F.col("ruled") == "allow", "t").otherwise("d").alias("kind")).agg(F.count("*").alias("n"))
    seeds = written(counts, "counts")
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = seeds.join(F.broadcast(totals), "kind").select("host", "kind", (F.col("n") / F.col("total")).alias("seed"))  # two rows at most
    ranks = propagate(host_links(pages), seeds, rounds=rounds)
    bad = F.round("distrust", 12) > F.lit(threshold) * F.round(F.col("trust") + F.col("distrust"), 12)
    return (
        found.join(ranks.withColumn("bad", bad), "host", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"), "trust", "distrust")
    )


def oracle(rules: list[Rule], rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in SQL, rounds written out."""
    order = sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r), reverse=True)
    fits = [(f"suffix('.' || host, '.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    link = LINK.replace("'", "''")
    parts = PARTS
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    head = f"""
WITH cut AS (SELECT page_id, html, {low(f"coalesce(regexp_extract(url, '{parts}', 1), '')")} AS host,
               coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
found AS (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS ruled FROM cut),
hosts AS (SELECT DISTINCT host FROM cut WHERE host <> ''),
kin AS (SELECT c.host AS child, p.host AS parent FROM hosts c JOIN hosts p ON suffix(c.host, '.' || p.host)),
pairs AS (SELECT host AS src, {low("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM cut WHERE html IS NOT NULL
  UNION ALL SELECT child, parent FROM kin UNION ALL SELECT parent, child FROM kin),
links AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM pairs WHERE src <> dst AND src <> '' GROUP BY 1, 2),
turned AS (SELECT 't' AS kind, src AS host, dst AS other, weight FROM links UNION ALL SELECT 'd', dst, src, weight FROM links),
arcs AS (SELECT kind, host, other, weight / sum(weight) OVER (PARTITION BY kind, host) AS share FROM turned),
counts AS (SELECT host, CASE ruled WHEN 'allow' THEN 't' ELSE 'd' END AS kind, count(*) AS n FROM found
  WHERE host <> '' AND ruled IS NOT NULL GROUP BY 1, 2),
r0 AS (SELECT host, kind, n / sum(n) OVER (PARTITION BY kind) AS rank FROM counts)"""
    steps = [
        f"""r{i} AS (SELECT host, kind, sum(rank) AS rank FROM (
  SELECT a.other AS host, kind, {damping} * rank * share AS rank FROM r{i - 1} JOIN arcs a USING (kind, host)
  UNION ALL SELECT host, kind, {1 - damping} * rank FROM r0) GROUP BY 1, 2)"""
        for i in range(1, rounds + 1)
    ]
    tail = f"""ranks AS (SELECT host, coalesce(sum(rank) FILTER (kind = 't'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'd'), 0) AS distrust
  FROM r{rounds} GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruled,
  CASE WHEN round(distrust, 12) > {threshold} * round(trust + distrust, 12) THEN 'block' END, 'allow') AS verdict
FROM found LEFT JOIN ranks USING (host)"""
    return ",\n".join([head, *steps, tail])
