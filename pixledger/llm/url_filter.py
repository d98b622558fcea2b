"""URL filter: fixed rules, and trust propagated over the link graph of hosts. DataFrame functions only.

A rule names a host and a path; it fits that host and its subdomains where the url's
path starts with the rule's. The longest fitting rule decides. For all other pages
the host decides: trust flows from allowed pages along host edges and distrust from
blocked pages against them, both as personalised PageRank, until the ranks settle; a
host whose distrust exceeds ``MARGIN`` times its trust by more than ``FLOOR`` is blocked.

A host's seeds are the shares of its pages that the rules allow and block; pages no rule
speaks of give neither. ``FLOOR`` is the rank of a host that has ``BLOCKED_SHARE`` of its
pages blocked and no links, so that one bad path does not sink a large host. A host
without pages of its own has the links to it for pages: rules judge them by host and
path. Edges are absolute links of the pages' html, counted by host pair before
anything else, and each host with its parent host where pages have that too.

A null url or one without ``://`` has an empty host and path and no rule; hosts
without edges keep their own seeds. Null html has no links. Equal rows get equal
verdicts, and repeated rows change no share. Hosts of a third of all
pages or links are counted before any shuffle by host. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import stored, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DAMPING, MARGIN, BLOCKED_SHARE = 0.85, 1.0, 0.2
FLOOR = (1 - DAMPING) * BLOCKED_SHARE
#: Ranks have settled when no host's changes by more than this in ``STEP`` rounds.
SETTLED, STEP, MOST_ROUNDS = 1e-4, 5, 100
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^"'\s>]+)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of ``url``."""
    at = F.locate("://", F.coalesce("url", F.lit("")))
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.lit(""))
    return pages.withColumns({"host": _lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def with_rule(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Pages with host and path, and the longest fitting rule with what it says; null where none fits."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, says = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(says)
    return pages.withColumns({"rule": rule, "says": says})


def seeds(ruled: DataFrame) -> DataFrame:
    """host, and its trust and distrust before any flows: the shares of rows that the rules allow and block."""
    share = lambda verdict: F.avg(F.coalesce(F.col("says") == verdict, F.lit(False)).cast("double"))
    return ruled.groupBy("host").agg(share("allow").alias("t"), share("block").alias("d"))


def links_of(parts: DataFrame) -> DataFrame:
    """from_host, host and path of the absolute links in the pages' html, once a page."""
    found = parts.where(F.col("html").rlike("(?i)href")).select(F.col("host").alias("from_host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    return found.select("from_host", _lower(F.regexp_extract("to", "^([^/?#]*)", 1)).alias("host"), F.regexp_extract("to", "^[^/?#]*([^?#]*)", 1).alias("path")).where("host <> ''")


def _ancestry(hosts: DataFrame) -> DataFrame:
    """a, b: each host and each of its parent domains of two labels or more, with that one's own parent."""
    labels = F.split("host", "\\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    chains = hosts.where("host <> ''").withColumn("labels", labels).where("size(labels) > 2").select(chain.alias("chain"))
    pair = F.explode(F.arrays_zip(F.expr("slice(chain, 1, size(chain) - 1)").alias("a"), F.expr("slice(chain, 2, size(chain) - 1)").alias("b")))
    return chains.select(pair.alias("p")).select("p.a", "p.b").distinct()


def host_edges(pairs: DataFrame, hosts: DataFrame) -> DataFrame:
    """a, b, weight: links from host a to host b (``pairs``: a, b, n), and both ways between ``hosts`` and their parent domains."""
    links = pairs.where("a <> b AND a <> ''").groupBy("a", "b").agg(F.sum("n").alias("n"))
    up = _ancestry(hosts).withColumn("n", F.lit(1).cast("long"))
    both = links.union(up).union(up.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.log1p(F.sum("n")).alias("weight"))


def propagated(start: DataFrame, edges: DataFrame) -> DataFrame:
    """host, t, d: personalised PageRank, trust along and distrust against the edges, when it has settled."""
    out = edges.groupBy("a").agg(F.sum("weight").alias("all"))
    into = edges.groupBy("b").agg(F.sum("weight").alias("all"))
    along = edges.join(out, "a").select(F.col("a").alias("host"), F.col("b").alias("to"), (F.col("weight") / F.col("all")).alias("wt"), F.lit(0.0).alias("wd"))
    against = edges.join(into, "b").select(F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("wt"), (F.col("weight") / F.col("all")).alias("wd"))
    flows = stored(along.union(against).groupBy("host", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")), "flows")
    nodes = start.unionByName(flows.select("host").withColumns({"t": F.lit(0.0), "d": F.lit(0.0)}).distinct())
    start = stored(nodes.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "nodes")
    mix = lambda own, more: ((1 - DAMPING) * F.col(own) + DAMPING * F.coalesce(more, F.lit(0.0))).alias(own)
    now = start.select("host", *(((1 - DAMPING) * F.col(c)).alias(c) for c in ("t", "d")))
    last = None
    for done in range(1, MOST_ROUNDS + 1):
        moved = now.join(flows, "host").groupBy("to").agg(F.sum(F.col("t") * F.col("wt")).alias("mt"), F.sum(F.col("d") * F.col("wd")).alias("md"))
        now = start.join(moved.withColumnRenamed("to", "host"), "host", "left").select("host", mix("t", "mt"), mix("d", "md"))
        if done % STEP:
            continue
        now = stored(now, "ranks")
        gap = F.greatest(F.abs(F.col("x.t") - F.col("y.t")), F.abs(F.col("x.d") - F.col("y.d")))
        if last is not None and (now.alias("x").join(last.alias("y"), "host").agg(F.max(gap)).first()[0] or 0) < SETTLED:
            break
        last = now
    return now


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with its host's trust and distrust."""
    parts = with_parts(pages.select("page_id", "url", "html"))
    ruled = with_rule(parts, rules)
    own = stored(seeds(ruled), "seeds")
    linked = with_rule(links_of(parts), rules).groupBy("from_host", "host", "says").agg(F.count("*").alias("n"))
    linked = stored(linked, "links")  # a row a pair of hosts and verdict
    pageless = linked.join(own.select("host"), "host", "left_anti")
    share = lambda verdict: (F.sum(F.when(F.col("says") == verdict, F.col("n")).otherwise(0)) / F.sum("n")).alias("t" if verdict == "allow" else "d")
    more = pageless.groupBy("host").agg(share("allow"), share("block"))
    start = own.unionByName(more)
    pairs = linked.select(F.col("from_host").alias("a"), F.col("host").alias("b"), "n")
    ranks = propagated(start, host_edges(pairs, own))
    hosts = ranks.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
    verdict = F.coalesce("says", F.when(F.col("distrust") > MARGIN * F.col("trust") + FLOOR, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", "rule", "says").join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust"
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
