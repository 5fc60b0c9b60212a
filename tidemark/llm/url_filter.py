"""URL filters: rules for hosts and paths, and propagation over the link graph where no rule fits.

Trust flows along host edges from hosts whose pages the rules allow, distrust
against them from hosts whose pages the rules block (personalised PageRank both
ways, the reversed one as in anti-trust ranking). Reversed PageRank divides the
distrust of a host among all that link to it, so verdicts go by harm: the chance
that a walk along the links, which stops at each host with 1 - damping, stops at a
blocked page. A host is blocked where harm prevails over trust and passes a threshold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, join_hot, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 10
#: Share of the distrust that a host could get from which on it is blocked; of its own pages, if nothing else speaks for or against it.
THRESHOLD = 0.5
#: Suffixes under which anyone can have a host: their hosts have nothing to do with one another.
SHARED = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.nz", "co.za",
    "appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "web.app", "wixsite.com", "wordpress.com",
)
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>\\]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end.

    Both are empty for null and for a url without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return _lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. ``rules`` is a short list in the configuration."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, shared: tuple[str, ...] = SHARED) -> DataFrame:
    """src, dst, weight, link (1, of domain edges alone 0): pages of a host that link to another host, and a host's pages to its parent domain and back.

    ``pages`` has host and html; html may be null or empty. A domain of ``shared``
    is no parent: trust and distrust don't pass between those who share it.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), _lower))).alias("dst"))
    parent = F.regexp_extract("host", r"\A[^.]+\.([^.]+\.[^.].*)", 1)
    up = pages.select(F.col("host").alias("src"), parent.alias("dst")).where((F.col("dst") != "") & ~F.col("dst").isin(*shared))
    edges = links.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.lit(1.0).alias("link"))
    tree = up.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.lit(0.0).alias("link"))
    back = tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "link")
    return edges.unionByName(tree).unionByName(back).groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"), F.max("link").alias("link"))


def propagate(seeds: DataFrame, edges: DataFrame, cut: Cut, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, all_trust, all_distrust after ``rounds`` rounds; ``seeds`` has host, trust and distrust in [0, 1].

    Trust is divided among the hosts that a host links to, distrust among those that
    link to it: PageRank along the links and against them. all_trust and all_distrust are the same
    with every host of the graph as a full seed: the most that a host could get where it stands. A host
    that nothing links to and of which no rule says anything is no seed.
    Contributions are summed on the map side, so a host that many link to sends
    one row from each task. The flows of such a host are dealt over many tasks. The
    table is written every other round.
    """
    out = cut(edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("c")))
    into = cut(edges.groupBy("dst").agg(F.sum("weight").alias("into"), F.count("*").alias("c")))
    shares = join_hot(join_hot(edges, out.drop("c"), ["src"], "dst", out), into.drop("c"), ["dst"], "src", into)
    shares = shares.select("src", "dst", (F.col("weight") / F.col("out")).alias("t"), (F.col("weight") / F.col("into")).alias("d"))
    along = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), "t", F.lit(0.0).alias("d"))
    against = shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), "d")
    flows = cut(along.unionByName(against).groupBy("host", "to").agg(*[F.sum(c).alias(c) for c in "td"]))
    busy = cut(flows.groupBy("host").agg(F.count("*").alias("c")))
    carried = {"trust": "t", "distrust": "d", "all_trust": "t", "all_distrust": "d"}
    one, none = F.lit(1.0), F.lit(0.0)
    nodes = seeds.select("host", "trust", "distrust", F.when(F.col("trust") + F.col("distrust") > 0, one).otherwise(none).alias("full")).unionByName(edges.select(F.col("dst").alias("host"), none.alias("trust"), none.alias("distrust"), F.col("link").alias("full")))
    nodes = nodes.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.max("full").alias("full"))
    part = [(F.col(c) * (1 - damping)).alias(n) for n, c in (("trust", "trust"), ("distrust", "distrust"), ("all_trust", "full"), ("all_distrust", "full"))]
    start = cut(nodes.select("host", "full", *part))
    ranks = start.drop("full")
    for k in range(rounds):
        sent = join_hot(flows, ranks, ["host"], "to", busy).select(F.col("to").alias("host"), *[(F.col(c) * F.col(x) * damping).alias(c) for c, x in carried.items()])
        ranks = start.drop("full").unionByName(sent).groupBy("host").agg(*[F.sum(c).alias(c) for c in carried])
        if k % 2 and k < rounds - 1:
            ranks = cut(ranks)
    return ranks.join(start.select("host", "full"), "host")


def shares_of(ranks: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``ranks`` (with ``full``: whether the host is a seed, and ``judged``: whether rules say anything of its own pages) with good and bad: trust and distrust as shares of the most that the host could get.

    A host of which no rule says anything gives no evidence of itself, so its own seed counts
    for neither side. Both shares are on one scale, from 0 to 1, and do not change with how many
    link to the hosts around.
    """
    own = F.when(F.col("judged"), 0.0).otherwise(F.col("full") * (1 - damping))
    part = lambda c: F.when(F.col(f"all_{c}") - own > 1e-12, F.col(c) / (F.col(f"all_{c}") - own)).otherwise(0.0)
    return ranks.withColumns({"good": part("trust"), "bad": part("distrust")})


def host_verdicts(pages: DataFrame, cut: Cut, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust, verdict for every host of ``pages`` (url, html) and every host that they link to.

    A host's seeds are the shares of its pages that a rule allows and blocks. It
    is blocked if its distrust is at least ``threshold`` of what it could be and at least
    its trust's share; otherwise, and with no evidence, allowed. So what a host
    links to weighs as much as who links to it.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(host.alias("host"), path.alias("path"), "html")
    said = rule_of(F.col("host"), F.col("path"), rules)[1]
    per = own.select("host", said.alias("said")).groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("b")
    )
    seeds = cut(per.select("host", (F.col("a") / F.col("n")).alias("trust"), (F.col("b") / F.col("n")).alias("distrust"), (F.col("a") + F.col("b") > 0).alias("judged")))
    ranks = propagate(seeds, cut(host_edges(own)), cut, damping, rounds)
    ranks = shares_of(ranks.join(seeds.select("host", "judged"), "host", "left").withColumn("judged", F.coalesce("judged", F.lit(False))), damping)
    # To nine decimals, so that sums in another order decide alike.
    good, bad = F.round("good", 9), F.round("bad", 9)
    return ranks.select("host", "trust", "distrust", F.when((bad >= good) & (bad >= threshold), "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, cut: Cut, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of ``pages`` (page_id, url, html).

    A row for each row: repeated ones count as so many pages of their host. A null
    url, and one without ``://``, has an empty host and path: no rule fits it, it
    links to nothing and nothing links to it, so it is allowed; null html has no
    links. A very long page costs one pass of a pattern.
    """
    hosts = host_verdicts(pages, cut, rules, **how).withColumnRenamed("verdict", "found")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said}).join(cut(hosts), "host", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", "found", F.lit("allow")).alias("verdict"), "trust", "distrust")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    nine = [F.round(c, 9).alias(c) for c in ("trust", "distrust")]
    return judge(pages, Cut(spark, "op5")).select("page_id", "host", "path", "rule", "verdict", *nine)


def oracle() -> str:
    """The query in DuckDB's SQL, its rounds unrolled."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    lower = lambda c: f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    fits = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h + p)}'" for v, h, p in fits) + " END"
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("trust", "distrust", "all_trust", "all_distrust"))
    steps = [f"""r{k + 1} AS MATERIALIZED (SELECT host, {sums} FROM (SELECT * FROM r0 UNION ALL
        SELECT dst, r.trust * t * {DAMPING}, 0, r.all_trust * t * {DAMPING}, 0 FROM r{k} r JOIN e ON r.host = e.src UNION ALL
        SELECT src, 0, r.distrust * d * {DAMPING}, 0, r.all_distrust * d * {DAMPING} FROM r{k} r JOIN e ON r.host = e.dst) GROUP BY host)""" for k in range(ROUNDS)]  # fmt: skip
    part = lambda c: f"CASE WHEN all_{c} - own > 1e-12 THEN round({c} / (all_{c} - own), 9) ELSE 0 END"
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (SELECT *, {case(lambda v, n: n)} AS rule, {case(lambda v, n: v)} AS said FROM (
    SELECT page_id, html, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, {quoted(LINK)}, 1), lambda x: {lower("x")}))) AS dst FROM p),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]+\\.([^.]+\\.[^.].*)', 1) AS dst FROM p),
tree AS (SELECT src, dst, count(*) AS w, 0 AS link FROM up WHERE dst <> '' AND dst NOT IN ({', '.join(map(quoted, SHARED))}) GROUP BY ALL),
w AS (SELECT src, dst, sum(w)::DOUBLE AS w, max(link) AS link FROM (SELECT src, dst, count(*) AS w, 1 AS link FROM l WHERE src <> dst AND src <> '' GROUP BY src, dst UNION ALL SELECT * FROM tree UNION ALL SELECT dst, src, w, link FROM tree) GROUP BY src, dst),
e AS MATERIALIZED (SELECT src, dst, link, w / sum(w) OVER (PARTITION BY src) AS t, w / sum(w) OVER (PARTITION BY dst) AS d FROM w),
s AS MATERIALIZED (SELECT host, a / n AS trust, b / n AS distrust, a + b > 0 AS judged FROM
    (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM p GROUP BY 1)),
r0 AS MATERIALIZED (SELECT host, sum(trust) * {1 - DAMPING} AS trust, sum(distrust) * {1 - DAMPING} AS distrust, max(link) * {1 - DAMPING}::DOUBLE AS all_trust, max(link) * {1 - DAMPING}::DOUBLE AS all_distrust FROM
    (SELECT host, trust, distrust, judged::INT AS link FROM s UNION ALL SELECT dst, 0, 0, link FROM e) GROUP BY host),
{', '.join(steps)},
f AS (SELECT host, trust, distrust, {part("trust")} AS good, {part("distrust")} AS bad FROM
    (SELECT r.*, CASE WHEN coalesce(judged, false) THEN 0 ELSE r0.all_trust END AS own FROM r{ROUNDS} r JOIN r0 ON r0.host = r.host LEFT JOIN s ON s.host = r.host))
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN bad >= good AND bad >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
    round(trust, 9) AS trust, round(distrust, 9) AS distrust FROM p LEFT JOIN f ON f.host = p.host
"""


ORACLE = oracle()
