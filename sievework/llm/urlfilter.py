"""URL filters: allow and block rules, and for other pages the host's standing in the link graph.

Trust flows from hosts of allowed pages along links, distrust from hosts of blocked pages against them, both as personalised
PageRank over host edges. A page without a rule is blocked if distrust makes up more than a threshold of its host's standing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sievework.llm.common import materialize

DAMPING = 0.85
#: Rounds end when all ranks together move by less than this, and no host's rank by more than this share of itself.
TOLERANCE = 1e-6
#: A host is blocked if distrust / (trust + distrust) exceeds this; a host that neither reaches is allowed.
BLOCK_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse(rule: str) -> Rule:
    """From `allow org/` or `block example.org/es/`."""
    verdict, _, target = rule.partition(" ")
    host, slash, path = target.partition("/")
    return Rule(verdict, host, slash + path)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(rules: tuple[Rule, ...], at: str = "host", of: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Among equally long ones the first by name counts."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((F.col(at) == r.host) | F.col(at).endswith("." + r.host)) & F.col(of).startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many links of pages (host, html) lead from host to host; relative links lead to the own host."""
    links = pages.where(F.col("host") != "").select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    to = F.when(absolute.contains("://"), host(absolute)).when(F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("host"))
    return links.select(F.col("host").alias("src"), to.alias("dst")).where(F.col("dst") != "").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def standing(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, good, bad).

    good and bad are shared out to sum to 1 each and are where walks restart, also from hosts without links. A sum of 0
    leaves that rank at 0. Verdicts compare a host's two ranks, however small, so rounds end when every rank rests in proportion to
    itself: a host far from all seeds counts as reached, too. A round shrinks what is left by damping; it sends four numbers
    to the driver."""
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = lambda c, t: F.coalesce(F.col(c) / F.lit(float(t or 0) or 1.0), F.lit(0.0))
    hosts = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    start = materialize(hosts.join(seeds.select("host", share("good", total["g"]).alias("g"), share("bad", total["b"]).alias("b")), "host", "left").na.fill(0.0), "hosts")
    outs = edges.groupBy("src").agg(F.sum("n").alias("out"))
    ins = edges.groupBy("dst").agg(F.sum("n").alias("in"))
    weighed = materialize(edges.join(outs, "src").join(ins, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("in")).alias("back")), "edges")
    ranks = start.select("host", F.col("g").alias("trust"), F.col("b").alias("distrust"))
    while True:
        forth = weighed.join(ranks, weighed["src"] == ranks["host"]).select(F.col("dst").alias("host"), (F.col("forth") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        back = weighed.join(ranks, weighed["dst"] == ranks["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("back") * F.col("distrust")).alias("d"))
        flow = forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        seen = Observation()
        moved = start.join(flow, "host", "left").join(ranks, "host").na.fill(0.0, ["t", "d"])
        moved = moved.select("host", "g", "b", "trust", "distrust", "t", "d").observe(seen, F.sum("t").alias("t"), F.sum("d").alias("d"))
        moved = materialize(moved, "flow")
        lost = seen.get
        lost_t = max(0.0, (1.0 if total["g"] else 0.0) - (lost["t"] or 0.0))
        lost_d = max(0.0, (1.0 if total["b"] else 0.0) - (lost["d"] or 0.0))
        trust = (1 - damping) * F.col("g") + damping * (F.col("t") + lost_t * F.col("g"))
        distrust = (1 - damping) * F.col("b") + damping * (F.col("d") + lost_d * F.col("b"))
        ranks = moved.select("host", trust.alias("trust"), distrust.alias("distrust"))
        steps = F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust"))
        shares = (F.when(step > 0, step / F.greatest(new, F.col(was))).otherwise(0.0) for step, new, was in zip(steps, (trust, distrust), ("trust", "distrust"), strict=True))
        change = moved.agg(F.sum(steps[0] + steps[1]).alias("all"), F.max(F.greatest(*shares)).alias("share")).first()
        if max(change["all"] or 0.0, change["share"] or 0.0) < tolerance:
            break
    return ranks


def judge(pages: DataFrame, rules: tuple[Rule, ...], share: float = BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of pages (page_id, url, html).

    The longest rule that fits gives rule and verdict. Other pages have a null rule and the verdict of their host's
    standing, for which every page with a rule is a seed of its host. Pages without a host (a null url, or one without
    ://) can't be reached and are allowed. Null html has no links; repeated pages count again; an empty table gives none."""
    parsed = pages.select("page_id", "url", "html").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_columns(rules)
    ruled = materialize(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "pages")
    seeds = ruled.where((F.col("host") != "") & F.col("rule").isNotNull()).groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    ranks = standing(materialize(host_edges(parsed.select("host", "html")), "links"), materialize(seeds, "seeds"))
    bad = F.col("distrust") > share * (F.col("trust") + F.col("distrust")) * (1 + 1e-9)
    out = ruled.join(ranks, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
