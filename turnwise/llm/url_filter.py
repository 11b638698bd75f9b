"""URL filters: rules by host and path, and trust propagated over the host graph; built-in functions only.

Rules fit a host with all its subdomains and a path prefix; the longest rule wins.  URLs that no rule fits are judged by
their host: links between different hosts give edges, weighted by their number.  Trust is a personalised PageRank from hosts by
the share of their URLs that rules allow; it follows links forwards, and is compared with a plain PageRank, so that it is the share
of what reaches a host that began at trusted ones.  Distrust starts from hosts by the share of their URLs that rules block and
follows links backwards: a host takes ``DAMPING`` times the mean distrust of what it links to, or its own share if that is larger.
So it depends on a host's own links alone, and neither on how many others link to the same blocked host nor on the mean over all
hosts.  A host is blocked if its distrust is at least ``LEAST_DISTRUST`` and larger than its trust.

Links are summed per pair of hosts before they are shuffled; every round is two joins on narrow host rows, written to the
shared folder.  The graph may be of any size; no part of it is collected.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; it is allowed, as is a host without
links or seeds.  Repeated rows get equal verdicts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import materialize

#: (host, path, action); a few literal rules, which become part of the plan.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS = 0.85, 12
LEAST_DISTRUST = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_of: Column, path_of: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as (text, action); both null if none fits."""
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    fits = [(host_of == h) | F.endswith(host_of, F.lit("." + h)) for h, _, _ in ordered]
    fits = [f & F.startswith(path_of, F.lit(p)) for f, (_, p, _) in zip(fits, ordered, strict=True)]
    pick = lambda values: reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in ordered]), pick([a for _, _, a in ordered])


def matched(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, action) of every row."""
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), path(url).alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("action", action)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts; a relative link stays on its page's host and is no edge."""
    own = host(F.col(f"`{url_col}`"))
    targets = F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*([^\"'\s>]+)"), F.lit(1))
    link = F.col("link")
    to = F.when(link.rlike(r"(?i)^https?://"), host(link)).when(F.startswith(link, F.lit("//")), host(F.concat(F.lit("http:"), link)))
    to = to.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("src"))
    # A page's links to one host are counted in its row; what is shuffled is one row for each pair of hosts and task.
    rows = pages.select(own.alias("src"), F.explode(targets).alias("link")).select("src", to.alias("dst"))
    return rows.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, name: str, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, plain, distrust) from edges(src, dst, links) and seeds(host, trust, distrust), which hold all hosts.

    ``trust`` and ``plain`` are PageRanks along the links, from the trust seeds and from all hosts alike; a host without links
    passes nothing on.  ``distrust`` goes against the links, weighted by the share of each in the links of its source.
    """
    whole = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    moves = materialize(edges.join(whole, "src").select("src", "dst", (F.col("links") / F.col("all_links")).alias("part")), f"{name}_moves")
    base = seeds.select("host", F.col("trust").alias("trust_seed"), F.col("distrust").alias("distrust_seed"))
    now = base.select("host", F.col("trust_seed").alias("trust"), F.lit(1.0).alias("plain"), F.col("distrust_seed").alias("distrust"))
    for step in range(rounds):
        sent = now.join(moves, now["host"] == moves["src"]).groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.col("trust") * F.col("part")).alias("got"), F.sum(F.col("plain") * F.col("part")).alias("plain_got")
        )
        back = now.join(moves, now["host"] == moves["dst"]).groupBy(F.col("src").alias("host")).agg(F.sum(F.col("distrust") * F.col("part")).alias("led_to"))
        got = lambda c: F.lit(damping) * F.coalesce(c, F.lit(0.0))
        now = base.join(sent, "host", "left").join(back, "host", "left").select(
            "host",
            (F.lit(1 - damping) * F.col("trust_seed") + got("got")).alias("trust"),
            (F.lit(1 - damping) + got("plain_got")).alias("plain"),
            F.greatest("distrust_seed", got("led_to")).alias("distrust"),
        )
        # A round reads the one before twice, so each is written: a narrow row per host.
        now = materialize(now, f"{name}_ranks{step}")
    return now


def host_verdicts(found: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(host, trust, distrust, host_blocked) from matched rows and edges.

    Seeds are the shares of a host's rows that rules allow and block; trust and distrust are from 0 to 1.
    """
    said = lambda action: F.sum((F.coalesce("action", F.lit("")) == action).cast("long"))
    hosts = found.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), said("allow").alias("allowed"), said("block").alias("blocked"))
    targets = edges.select(F.col("dst").alias("host")).distinct()
    hosts = hosts.join(targets, "host", "full").na.fill(0, ["n", "allowed", "blocked"])
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    seeds = materialize(hosts.select("host", share("allowed").alias("trust"), share("blocked").alias("distrust")), f"{name}_seeds")
    ranks = propagate(edges, seeds, name).select("host", (F.col("trust") / F.col("plain")).alias("trust"), "distrust")
    # Rounded, so that the order in which ranks are summed cannot turn a verdict at the threshold.
    blocked = (F.round("distrust", 6) >= LEAST_DISTRUST) & (F.round("distrust", 6) > F.round("trust", 6))
    return ranks.withColumn("host_blocked", blocked)


def judged(pages: DataFrame, name: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row."""
    found = materialize(matched(pages, id_col, url_col, rules), f"{name}_matched")
    edges = materialize(host_edges(pages, url_col, html_col), f"{name}_edges")
    hosts = materialize(host_verdicts(found, edges, name), f"{name}_verdicts")
    verdict = F.coalesce(F.col("action"), F.when(F.col("host_blocked"), "block").otherwise("allow"))
    return found.join(hosts, "host", "left").select("id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
