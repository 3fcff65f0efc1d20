"""URL filter by rules and by link-graph propagation (native: DataFrame functions only).

Rules first: the longest rule whose host is the url's or a parent domain of it, and whose path starts the url's path,
decides. For the other urls the host decides:

1. Nodes are names of hosts without user and port: those of pages, those that pages link to, and their parent domains up
   to the registered one, with pages or without.
2. Edges: links of a page to other hosts (absolute links in attributes), counted once per page and host
   and added up before any shuffle by host; and an edge each way between a node and its parent domain.
3. Seeds: the rules' verdicts on a host's own pages. A host is a blocked seed by as much as its share of blocked pages is above that of all
   others, a trusted one by as much as its share of allowed pages is above that of blocked ones; so one blocked folder does not
   condemn the others. A host without pages is a seed if a rule for its whole host fits. ``seeds`` adds others.
4. Personalised PageRank from the trusted seeds along the edges, and from the blocked seeds against them (who
   links to a bad host is suspect): one join and one aggregate a round for both at once. What moves after n rounds is less than
   DAMPING ** n of the seeds, so ``ROUNDS`` follows from ``TOLERANCE``. Mass that reaches a node without a way out goes back to the
   seeds; that is the same as dividing by what is left in the end, so both kinds sum to their seeds' weights.
5. A host is blocked if its distrust exceeds ``THRESHOLD`` of the sum of both and ``NEUTRAL``, which every host has; hosts without either are allowed.

Pages of one host never meet in one task: edges and seeds are summed partially first, and the last join is of
plain tables, which adaptive execution splits. Out-weights and ranks are one row per host.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and is blocked, as nothing vouches for it.
Null html has no links; very long html is read whole. Equal scores for and against are no block; no other ties arise. Repeated rows repeat.
An empty table gives an empty result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

DAMPING, TOLERANCE, THRESHOLD = 0.7, 1e-3, 0.5
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: What distrust must overcome at any host, as a part of one full seed.
NEUTRAL = 0.1
#: Edges between a host and its parent domain weigh as much as this many linking pages.
PARENT_WEIGHT = 1.0
#: Host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of at least two labels, not addresses; endings of which the registered domain has three labels, not two.
NAME = r"^(?=.{1,253}$)(?![0-9.]+$)(?!\[)(?:[^.]+\.)+[^.]+$"
SUFFIX = r"\.(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}$"
#: What a url's host holds beside the name.
BESIDE = r"^[^@]*@|:[0-9]*$"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'<>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the rule that wins, or null."""
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def parent_steps(host: Column) -> Column:
    """array<struct(child, parent)> from a host up to its registered domain; empty for addresses and for what is no name."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    kept = F.when(host.rlike(SUFFIX), 3).otherwise(2)
    tail = lambda i: F.array_join(F.slice(labels, i, n), ".")
    steps = F.transform(F.sequence(F.lit(1), n - kept), lambda i: F.struct(tail(i).alias("child"), tail(i + 1).alias("parent")))
    return F.when(host.rlike(NAME) & (n > kept), steps)


def name_of(host: Column) -> Column:
    """The node of a url's host: without user and port."""
    return F.translate(F.regexp_replace(host, BESIDE, ""), _UPPER, _LOWER)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) over all nodes that urls or links name, and their parent domains; pages has host, html."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), name_of))
    linked = written(
        pages.select(name_of(F.col("host")).alias("src"), F.explode(links).alias("dst"))
        .filter((F.col("dst") != F.col("src")) & (F.col("src") != "") & (F.col("dst") != ""))
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    named = pages.select(name_of(F.col("host"))).distinct().union(linked.select("dst")).distinct().toDF("host")
    steps = named.select(F.explode(parent_steps(F.col("host"))).alias("step")).distinct()
    up = steps.select(F.col("step.child").alias("src"), F.col("step.parent").alias("dst"), F.lit(PARENT_WEIGHT).alias("weight"))
    both = linked.select("src", "dst", "weight").union(up).union(up.select(F.col("dst"), F.col("src"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rule_seeds(pages: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, host, seed): what the rules say on each host's pages, and on whole hosts without pages; pages has host, path."""
    name, path = name_of(F.col("host")), F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    verdict = lambda host, path: F.coalesce(longest_rule(host, path, rules)["verdict"], F.lit(""))
    own = pages.filter(name != "").select(name.alias("host"), verdict(name, path).alias("v"))
    share = lambda v: F.avg((F.col("v") == v).cast("double"))
    crawled = own.groupBy("host").agg((share("allow") - share("block")).alias("trust"), (2 * share("block") - 1).alias("distrust"))
    others = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct().join(crawled, "host", "left_anti")
    named = others.withColumn("v", verdict(F.col("host"), F.lit("/"))).select("host", (F.col("v") == "allow").cast("double").alias("trust"), (F.col("v") == "block").cast("double").alias("distrust"))
    both = crawled.union(named)
    kinds = (both.select(F.lit(k).alias("kind"), "host", F.col(k).alias("seed")) for k in ("trust", "distrust"))
    return reduce(DataFrame.union, kinds).filter("seed > 0")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) of personalised PageRank, a kind's scores summing to its seeds: edges (kind, src, dst, weight), seeds (kind, host, seed)."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    share = written(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share")))
    start = seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    score = start
    for i in range(rounds):
        moved = score.join(share, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score"))
        score = start.union(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % 5 == 4:
            score = written(score)
    want, left = seeds.groupBy("kind").agg(F.sum("seed").alias("want")), score.groupBy("kind").agg(F.sum("score").alias("left"))
    scale = want.join(left, "kind").select("kind", (F.col("want") / F.col("left")).alias("scale"))
    return score.join(F.broadcast(scale), "kind").select("kind", "host", (F.col("score") * F.col("scale")).alias("score"))


def host_scores(pages: DataFrame, rules: list[tuple[str, str, str]], seeds: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust, blocked) of every node that either reaches; pages has host, path, html; seeds is a further table (kind, host, seed)."""
    edges = written(host_edges(pages))
    start = rule_seeds(pages, edges, rules)
    if seeds is not None:
        start = start.union(seeds.select("kind", "host", F.col("seed").cast("double"))).groupBy("kind", "host").agg(F.sum("seed").alias("seed"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    score = propagate(both, written(start))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    per_host = score.groupBy("host").agg(of("trust"), of("distrust"))
    return written(per_host.withColumn("blocked", F.col("distrust") > THRESHOLD * (F.col("trust") + F.col("distrust") + NEUTRAL) + 1e-9))


def url_filter(
    df: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds: DataFrame | None = None
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    host, path = url_parts(F.col(url_col))
    pages = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    verdicts = host_scores(pages, rules, seeds).select(F.col("host").alias("_name"), "blocked")
    won = longest_rule(F.col("host"), F.col("path"), rules)
    named = pages.select(F.col("_id").alias(id_col), "host", "path", name_of(F.col("host")).alias("_name")).join(verdicts, "_name", "left")
    own = F.when((F.col("host") == "") | F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return named.select(id_col, "host", "path", won["rule"].alias("rule"), F.coalesce(won["verdict"], own).alias("verdict"))


def _oracle() -> str:
    """The definitions once more in DuckDB's SQL: rules as a join, parents by recursion, one step of the walk for each round."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link, beside = LINK.replace("'", "''"), BESIDE.replace("'", "''")
    name = lambda x: f"translate(regexp_replace({x}, '{beside}', '', 'g'), '{_UPPER}', '{_LOWER}')"
    fit = lambda host, path: f"({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, rules.p)"
    rounds = ["r0 AS (SELECT * FROM start)"]
    for i in range(1, ROUNDS + 1):
        rounds.append(
            f"r{i} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM start UNION ALL SELECT kind, dst, {DAMPING} * score * share "
            f"FROM r{i - 1} JOIN share USING (kind, host)) GROUP BY kind, host)"
        )
    return f"""
WITH RECURSIVE rules(h, p, verdict) AS (VALUES {values}),
u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p0 AS (SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS html,
             translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS MATERIALIZED (SELECT *, {name("host")} AS name FROM p0),
won AS (SELECT k, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
        FROM p JOIN rules ON {fit("host", "path")} GROUP BY k),
said AS (SELECT k, arg_max(verdict, length(h || rules.p)) AS v FROM p JOIN rules ON {fit("name", "CASE WHEN path = '' THEN '/' ELSE path END")} GROUP BY k),
linked AS (SELECT name AS src, dst, count(*)::DOUBLE AS weight
           FROM p, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: {name("x")}))) AS l(dst)
           WHERE dst <> name AND name <> '' AND dst <> '' GROUP BY name, dst),
up AS (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM (SELECT name AS host FROM p UNION SELECT dst FROM linked)
       WHERE regexp_matches(host, '^([^.]+[.])+[^.]+$') AND length(host) <= 253 AND NOT regexp_matches(host, '^[0-9.]+$') AND NOT starts_with(host, '[')
         AND len(string_split(host, '.')) > CASE WHEN regexp_matches(host, '{SUFFIX}') THEN 3 ELSE 2 END
       UNION SELECT dst, substr(dst, instr(dst, '.') + 1) FROM up WHERE len(string_split(dst, '.')) > CASE WHEN regexp_matches(dst, '{SUFFIX}') THEN 3 ELSE 2 END),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight
          FROM (SELECT * FROM linked UNION ALL SELECT src, dst, {PARENT_WEIGHT} FROM up UNION ALL SELECT dst, src, {PARENT_WEIGHT} FROM up) GROUP BY src, dst),
crawled AS (SELECT name AS host, avg((v IS NOT DISTINCT FROM 'allow')::INT) - avg((v IS NOT DISTINCT FROM 'block')::INT) AS trust, 2 * avg((v IS NOT DISTINCT FROM 'block')::INT) - 1 AS distrust
            FROM p LEFT JOIN said USING (k) WHERE name <> '' GROUP BY name),
others AS (SELECT host, arg_max(verdict, length(h || rules.p)) AS v FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges EXCEPT SELECT host FROM crawled)
           JOIN rules ON {fit("host", "'/'")} GROUP BY host),
seeds AS (SELECT * FROM (SELECT 'trust' AS kind, host, trust AS seed FROM crawled UNION ALL SELECT 'distrust', host, distrust FROM crawled
          UNION ALL SELECT CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END, host, 1 FROM others) WHERE seed > 0),
start AS MATERIALIZED (SELECT kind, host, {1 - DAMPING} * seed AS score FROM seeds),
both_ways AS (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
share AS MATERIALIZED (SELECT kind, src AS host, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM both_ways),
{", ".join(rounds)},
scale AS (SELECT kind, want / got AS scale FROM (SELECT kind, sum(seed) AS want FROM seeds GROUP BY kind) JOIN (SELECT kind, sum(score) AS got FROM r{ROUNDS} GROUP BY kind) USING (kind)),
v AS (SELECT host, coalesce(sum(score * scale) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(score * scale) FILTER (kind = 'distrust'), 0) AS d
      FROM r{ROUNDS} JOIN scale USING (kind) GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN p.host = '' OR coalesce(d > {THRESHOLD} * (t + d + {NEUTRAL}) + 1e-9, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN won USING (k) LEFT JOIN v ON p.name = v.host
"""


ORACLE = _oracle()
