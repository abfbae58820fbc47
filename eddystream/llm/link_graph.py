"""URL filter by link-graph propagation.

Rules decide the urls that they fit. For all others the host decides: trust
flows from hosts with allowed pages along links (personalised PageRank), and
distrust from hosts with blocked pages against the links, to those that link to
them. A host's distrust from others is the mean of what its own links go to, so
that a farm of any size around one blocked host is blocked host by host. Both
are linear in their seeds, each of which is worth 1: a host's score doesn't
shrink as the web grows, and one threshold fits all. A host without links
passes nothing on. Scores are whole numbers of 1/SCALE, so that a rerun, in
whatever order, gives the same ones; they start at nothing, grow, and are
taken once a round moves none of them by more than TOLERANCE.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddystream.llm.common import dropped, plain, stored

SCALE = 1_000_000_000
#: Hundredths of a host's score that go on along its links.
DAMPING = 85
#: A host is blocked if its distrust exceeds its trust and a fifth of what a host has all of whose pages are blocked.
LEAST = SCALE * (100 - DAMPING) // 100 // 5
#: Rounds end once no score moves by more: what is left then adds up to less than a hundredth of LEAST.
TOLERANCE = LEAST // 1000
#: Bytes of hosts and scores that are broadcast to the pages at most; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?(?:https?:)?//([^/?#"'<> \t\r\n]+)"""


@dataclass(frozen=True)
class Rule:
    """Blocks or allows urls of a host and its subdomains whose path starts with the rule's."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = (
    Rule("com/en/", False), Rule("example.com/en/7", True), Rule("net/de/", True),
    Rule("example.net/de/8", False), Rule("org/es/", False),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path as a url has them; empty without a ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and whether it allows; both null if none does."""
    text = allow = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, allow = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return text.cast("string"), allow.cast("boolean")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the distinct links between different hosts that ``pages`` (url, html) hold."""
    host, _ = host_path(F.col("url"))
    to = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    links = plain(pages, "url", "html").select(host.alias("src"), to.alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return links.where("src <> '' and src <> dst").distinct()


def propagate(hosts: DataFrame, links: DataFrame, tolerance: int = TOLERANCE, damping: int = DAMPING) -> DataFrame:
    """(host, trust, distrust) of ``hosts`` (host, good, bad: its shares of allowed and blocked pages, in 1/SCALE) and all that ``links`` name.

    A round gives each host what its seeds are worth, the trust that hosts
    linking to it pass on, shared evenly by their links, and the mean distrust
    of the hosts that it links to. The rounds' number follows from the graph
    and ``tolerance``. Every round is written to the shared folder, so lineage
    stays short.
    """
    links = stored(links, "links")
    out = links.groupBy(F.col("src").alias("host")).agg(F.count("*").alias("n_out"))
    named = hosts.select("host").union(out.select("host")).union(links.select("dst")).distinct()
    now = named.join(hosts, "host", "left").join(out, "host", "left").select(
        "host", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "bad", "n_out")), *(F.lit(0).cast("long").alias(c) for c in ("trust", "distrust"))
    )
    now = stored(now, "hosts")
    while True:
        gives = now.where("n_out > 0").select(F.col("host").alias("src"), F.expr("trust div n_out").alias("t"))
        takes = now.where("distrust > 0").select(F.col("host").alias("dst"), F.col("distrust").alias("d"))
        got = links.join(gives, "src").select(F.col("dst").alias("host"), "t", F.lit(0).cast("long").alias("d")).union(
            links.join(takes, "dst").select(F.col("src").alias("host"), F.lit(0).cast("long"), "d")
        )
        got = now.join(got.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "host", "left")
        step = lambda seed, more: F.expr(f"({100 - damping} * {seed} + {damping} * coalesce({more}, 0)) div 100")
        trust, distrust = step("good", "t"), step("bad", "d div greatest(n_out, 1)")
        moved = F.greatest(F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust")))
        new = stored(got.select("host", "good", "bad", "n_out", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")), "hosts")
        dropped(now)
        now = new
        if not new.where(F.col("moved") > tolerance).limit(1).count():
            return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, tolerance: int = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages`` (page_id, url, html).

    A null url or one without ``://`` has an empty host and path, fits no rule,
    belongs to no node of the graph (trust and distrust 0) and is allowed. A
    null html has no links. Repeated rows are pages of their own. Hosts that no
    seed reaches are allowed. An html of any length is searched whole. An empty
    table gives no rows.
    """
    host, path = host_path(F.col("url"))
    rows = plain(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, allow = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("allow", allow)
    share = lambda what: F.expr(f"count_if({what}) * {SCALE} div count(*)")
    hosts = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("not allow").alias("bad"))
    scores = propagate(hosts, host_links(pages), tolerance)
    # pages of one host may be a third of all, so the few rows a host are sent to them if they are few
    size = scores.agg(F.coalesce(F.sum(F.octet_length("host") + 32), F.lit(0))).first()[0]
    scores = F.broadcast(scores) if size <= BROADCAST_BYTES else scores
    joined = rows.join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("trust", "distrust")})
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > LEAST)
    verdict = F.when(F.coalesce(F.col("allow"), ~blocked), "allow").otherwise("block")
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op1_link_graph(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql(tolerance: int = TOLERANCE) -> str:
    fits = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: -len(r.text))
    when = lambda what: "CASE " + " ".join(f"WHEN {fits.format(h=r.host, p=r.path)} THEN {what(r)}" for r in by_length) + " END"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT *, {when(lambda r: f"'{r.text}'")} AS rule, {when(lambda r: str(r.allow).upper())} AS allow FROM parts
), hosts AS (
  SELECT host, (count(*) FILTER (allow)) * {SCALE} // count(*) AS good, (count(*) FILTER (NOT allow)) * {SCALE} // count(*) AS bad
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT DISTINCT host AS src, translate(dst, '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM parts)
  WHERE host <> '' AND host <> translate(dst, '{UPPER}', '{LOWER}')
), named AS (
  SELECT host FROM hosts UNION SELECT src FROM links UNION SELECT dst FROM links
), nodes AS MATERIALIZED (
  SELECT n.host, coalesce(h.good, 0) AS good, coalesce(h.bad, 0) AS bad, coalesce(o.n, 0) AS n_out
  FROM named n LEFT JOIN hosts h ON h.host = n.host LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) o ON o.src = n.host
), rounds AS (
  SELECT 0 AS i, host, good, bad, n_out, CAST(0 AS BIGINT) AS trust, CAST(0 AS BIGINT) AS distrust, CAST({tolerance} + 1 AS BIGINT) AS moved FROM nodes
  UNION ALL
  SELECT i + 1, host, good, bad, n_out, t, d, greatest(abs(t - trust), abs(d - distrust))
  FROM (
    SELECT r.*, CAST(({100 - DAMPING} * r.good + {DAMPING} * coalesce(t.t, 0)) // 100 AS BIGINT) AS t,
           CAST(({100 - DAMPING} * r.bad + {DAMPING} * (coalesce(d.d, 0) // greatest(r.n_out, 1))) // 100 AS BIGINT) AS d
    FROM rounds r
    LEFT JOIN (SELECT l.dst AS host, sum(x.trust // x.n_out) AS t FROM links l JOIN rounds x ON x.host = l.src GROUP BY l.dst) t ON t.host = r.host
    LEFT JOIN (SELECT l.src AS host, sum(x.distrust) AS d FROM links l JOIN rounds x ON x.host = l.dst GROUP BY l.src) d ON d.host = r.host
  ) WHERE (SELECT max(moved) FROM rounds) > {tolerance}
), scores AS (SELECT host, trust, distrust FROM rounds WHERE i = (SELECT max(i) FROM rounds))
SELECT j.page_id, j.host, j.path, j.rule,
       CASE WHEN coalesce(j.allow, NOT (coalesce(s.distrust, 0) > coalesce(s.trust, 0) AND coalesce(s.distrust, 0) > {LEAST})) THEN 'allow' ELSE 'block' END AS verdict,
       CAST(coalesce(s.trust, 0) AS BIGINT) AS trust, CAST(coalesce(s.distrust, 0) AS BIGINT) AS distrust
FROM judged j LEFT JOIN scores s ON s.host = j.host
"""


OP1_SQL = sql()
