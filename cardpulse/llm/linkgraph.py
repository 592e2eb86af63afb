"""URL verdicts: host and path rules, and for the rest a link-graph score by trusted and distrusted page rank.

Trust flows from the hosts of rule-allowed pages along links, distrust from the hosts of rule-blocked pages against them: who links to
a blocked host is suspect. Both are personalised page ranks over distinct host pairs, iterated as joins and pre-aggregated
sums of DataFrames; a host is blocked when its distrust exceeds its trust by more than a threshold. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, durable

#: Share of a score that is passed on, number of rounds beyond which something is wrong, change at which rounds end, and how far distrust
#: may exceed trust.
DAMPING, ROUNDS, SETTLED, THRESHOLD = 0.85, 1000, 1e-6, 0.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A rule: host, path and whether it allows.
Rule = tuple[str, str, bool]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as host and path; null if none does. A rule fits its host and all subdomains where the path begins with
    the rule's."""
    out = None
    for rule_host, rule_path, _ in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.lit(rule_host + rule_path)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return F.lit(None).cast("string") if out is None else out


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts, by the absolute links in ``html`` of ``pages`` (host, html)."""
    pattern = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
    found = pages.where("html IS NOT NULL AND host <> ''").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("target"))
    found = found.withColumn("target", F.translate("target", _UPPER, _LOWER)).where("source <> target")
    return found.groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(ws: Workspace, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised page rank over ``edges`` (kind, source, target, share) from ``seeds`` (kind, host, score; a kind's scores sum to one):
    (kind, host, score). Several kinds run at once; only hosts with a score have rows. Rounds go on until the scores change by less than
    SETTLED in all and no further host is reached; an error if that takes more than ``rounds``."""
    start = ws.table(seeds)
    scores = start
    for _ in range(rounds):
        passed = scores.join(edges.select(F.col("kind").alias("k"), F.col("source").alias("s"), "target", "share"), (F.col("kind") == F.col("k")) & (F.col("host") == F.col("s")))
        passed = passed.groupBy("kind", "target").agg(F.sum(F.col("score") * F.col("share")).alias("score"))
        parts = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score")).union(passed.select("kind", "target", F.col("score") * damping))
        new = ws.table(parts.groupBy("kind", "host").agg(F.sum("score").alias("score")))
        both = scores.select("kind", "host", (-F.col("score")).alias("score")).union(new)
        moved, reached = both.groupBy("kind", "host").agg(F.sum("score").alias("d"), F.count_if(F.col("score") < 0).alias("old")).agg(F.sum(F.abs("d")), F.count_if(F.col("old") == 0)).first()
        if scores is not start:
            ws.drop(scores)
        scores = new
        if (moved or 0.0) < SETTLED and not reached:
            break
    else:
        raise RuntimeError(f"scores did not settle in {rounds} rounds")
    return scores


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Verdict on every url: ``page_id``, ``host``, ``path``, ``rule`` (the longest that fits, else null), ``verdict`` (allow or block: the
    rule's, else that of the host's scores), ``trust`` and ``distrust`` of the host.

    A host's trust starts from its share of all rule-allowed pages, its distrust from its share of all rule-blocked ones; a host without
    either score is allowed. Null urls and those without ``://`` have an empty host and path, fit no rule and are allowed; null
    pages have no links. Ids may be null or repeat, and repeated pages count as pages each; other columns are ignored; an empty table gives an
    empty result. A very long page is one row's work, linear in its length.
    """
    spark: SparkSession = pages.sparkSession
    with Workspace(spark, "linkgraph") as ws:
        source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
        named = source.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
        ruled = ws.table(named.drop("html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
        links = ws.table(host_links(named))

        allowing = [h + p for h, p, allow in rules if allow]
        kind = F.when(F.col("rule").isin(allowing), F.lit("trust")).otherwise(F.lit("distrust"))
        hits = ws.table(ruled.where("rule IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n")))
        totals = hits.groupBy("kind").agg(F.sum("n").alias("total"))
        seeds = hits.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("score"))
        # links are shared out by the degree of where a score comes from: trust follows them, distrust runs against them
        out = ws.table(links.groupBy("source").agg(F.sum("links").alias("m")))
        into = ws.table(links.groupBy("target").agg(F.sum("links").alias("m")))
        share = F.col("links") / F.col("m")
        forward = links.join(out, "source").select(F.lit("trust").alias("kind"), "source", "target", share.alias("share"))
        back = links.join(into, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), share.alias("share"))
        edges = ws.table(forward.union(back))
        scores = propagate(ws, edges, seeds)
        by_host = ws.table(scores.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust"))))

        zero = F.lit(0.0)
        trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
        by_rule = F.when(F.col("rule").isin(allowing), F.lit("allow")).otherwise(F.lit("block"))
        by_score = F.when(distrust - trust > threshold, F.lit("block")).otherwise(F.lit("allow"))
        result = ruled.join(by_host, "host", "left").select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_score).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
        return durable(spark, result)
