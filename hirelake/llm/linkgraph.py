"""URL filters: rules first, then trust and distrust over the host graph.

Trust is a personalised PageRank that starts at trusted hosts and follows
links; distrust starts at blocked hosts and follows links backwards, to those
that link to them.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import landed

#: (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: The part of a host's rank that its links hand on.
DAMPING = 0.85
#: Iteration ends when the ranks of all hosts together move by less.
TOLERANCE = 1e-4
MOST_ROUNDS = 60
#: Rounds between tables that cut the lineage.
ROUNDS_A_TABLE = 4
#: A host is a seed when rules judge at least this part of its pages that way.
SEED_SHARE = 0.5
#: A host is blocked when its distrust is over this many times its trust.
BLOCK_RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative links.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def matched(rules, host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        told = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, told).otherwise(found)
    return found


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (null where no rule fits)."""
    host, path = host_and_path(F.col("url"))
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("told", matched(rules, F.col("host"), F.col("path")))
        .select("page_id", "host", "path", "told.rule", "told.verdict")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: ``src``, ``dst``, ``links``.  Relative links stay on a host."""
    host, _ = host_and_path(F.col("url"))
    targets = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    return (
        pages.select(host.alias("src"), targets.alias("dst"))
        .withColumn("dst", F.translate("dst", UPPER, LOWER))
        .filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def seeds(judged: DataFrame) -> DataFrame:
    """``kind`` (trust, distrust), ``host``, ``seed``: equal parts that sum to 1 in each kind.

    One row per host is all that is counted here.
    """
    share = {
        kind: F.avg(F.when(F.col("verdict") == verdict, 1.0).otherwise(0.0)) >= SEED_SHARE
        for kind, verdict in (("trust", "allow"), ("distrust", "block"))
    }
    by_host = (
        judged.filter(F.col("host") != "")
        .groupBy("host")
        .agg(*(test.alias(kind) for kind, test in share.items()))
    )
    kinds = F.array(*(F.when(F.col(kind), F.lit(kind)) for kind in share))
    rows = by_host.select("host", F.explode(F.array_compact(kinds)).alias("kind"))
    number = rows.groupBy("kind").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(number), "kind").select("kind", "host", (1 / F.col("n")).alias("seed"))


def ranks(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """``kind``, ``host``, ``rank`` of both walks, one row where the rank is not 0.

    Both inputs are used in every round, so land them first.  A host without
    links on hands its rank to nobody; only the ratio of the two ranks counts.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(
        edges.select(
            F.lit("distrust").alias("kind"),
            F.col("dst").alias("src"),
            F.col("src").alias("dst"),
            "links",
        )
    )
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("all_links"))
    weights = landed(
        both.join(out, ["kind", "src"]).select(
            "kind", "src", "dst", (F.col("links") / F.col("all_links")).alias("weight")
        ),
        "host-links",
    )
    given = seed.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("rank"))
    if weights.isEmpty():
        return given
    now = given
    for n in range(1, MOST_ROUNDS + 1):
        # ``now`` descends from ``weights``: only names tell their columns apart.
        handed = (
            now.alias("now")
            .join(weights.alias("out"), (F.col("now.kind") == F.col("out.kind")) & (F.col("now.host") == F.col("out.src")))
            .select(
                F.col("out.kind").alias("kind"),
                F.col("out.dst").alias("host"),
                (DAMPING * F.col("now.rank") * F.col("out.weight")).alias("rank"),
            )
        )
        after = handed.unionByName(given).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if n % ROUNDS_A_TABLE == 0:
            after = landed(after, "ranks")
            moved = (
                after.alias("a")
                .join(now.alias("b"), ["kind", "host"], "left")
                .agg(F.sum(F.abs(F.col("a.rank") - F.coalesce(F.col("b.rank"), F.lit(0.0)))).alias("moved"))
                .first()
                .moved
            )
            if (moved or 0.0) < TOLERANCE:
                return after
        now = after
    return now


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    ``rules`` is a short list of (host, path, verdict).  A page that no rule
    fits is blocked when its host's distrust is over ``BLOCK_RATIO`` times its
    trust.  A host that neither walk reaches is allowed, as is an empty host
    (null url, or one without ``://``).  Null html has no links.  Repeated rows
    are judged alike, and each counts as a page of its host.
    """
    judged = parsed(pages, rules)
    rank = ranks(landed(host_edges(pages), "host-edges"), landed(seeds(judged), "seeds"))
    by_host = rank.groupBy("host").agg(
        *(
            F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
            for kind in ("trust", "distrust")
        )
    )
    trust, distrust = (F.coalesce(F.col(kind), F.lit(0.0)) for kind in ("trust", "distrust"))
    walked = F.when(distrust > BLOCK_RATIO * trust, "block").otherwise("allow")
    return judged.join(by_host, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", walked).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
