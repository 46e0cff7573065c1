"""URL filtering: longest-match rules, then link-graph propagation per host.

Method: pages that a rule allows seed trust on their host, pages that a rule blocks seed
distrust. Trust runs along the host edges as a personalised PageRank; distrust runs along
the reversed edges, so a host that links to blocked hosts takes their distrust on. Pages
without a rule get their host's verdict: block where the host's distrust for each page,
less its trust for each page, exceeds ``threshold`` times the average seed density.

A host without links keeps its mass, as if it linked to itself, so no mass is lost and
the masses are the personalised PageRank distribution. Rounds go on until all masses
together change by no more than a millionth; each shrinks the change to 0.85 at most, so
that takes below ninety. Masses are fixed-point integers, so reruns agree to the last
unit.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import dropped, stored

#: (host/path, verdict) of the contract.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
MASS = 1_000_000_000_000
SETTLED = MASS // 1_000_000
SALTS = 32
#: Links of a host that are handled in one task.
CROWDED = 10_000
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
RELATIVE = r"""(?i)\bhref\s*=\s*["']?\s*(?:/(?!/)|[^"'\s<>:/]+["'\s>/])"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none; ties to the smaller rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        cut = name.index("/")
        fits = ((host == name[:cut]) | host.endswith("." + name[:cut])) & path.startswith(name[cut:])
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) between hosts that have pages; relative links point home."""
    links = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    home = F.when(F.col("html").rlike(RELATIVE), F.array("host")).otherwise(F.array().cast("array<string>"))
    out = (
        pages.filter("html IS NOT NULL AND host <> ''")
        .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.concat(home, F.transform(links, ascii_lower)))).alias("dst"))
        .distinct()
    )
    return out.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")


def propagate(hosts: DataFrame, edges: DataFrame, settled: int = SETTLED, crowded: int = CROWDED) -> DataFrame:
    """(host, trust, distrust) masses once a round changes them by ``settled`` at most.

    hosts: (host, allowed, blocked). Each round is one join and one map-side combined
    sum for both masses, and its small state is written down. A host with many links
    sends its share to each of the salts that its links are dealt over.
    """
    totals = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("n")).first()
    settled = max(settled, totals["n"])  # rounding moves a unit of mass a host
    good, bad = max(1, totals["a"] or 0), max(1, totals["b"] or 0)
    kinds = F.explode(
        F.array(
            F.struct(F.lit("t").alias("kind"), F.expr(f"({MASS} div {good}) * allowed").alias("seed")),
            F.struct(F.lit("d").alias("kind"), F.expr(f"({MASS} div {bad}) * blocked").alias("seed")),
        )
    )
    seeds = hosts.select("host", kinds.alias("k")).select(F.col("host").alias("node"), "k.kind", "k.seed")
    both = edges.select(F.lit("t").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"))
    )
    both = stored(both, "links")
    degrees = both.groupBy("kind", "a").agg(F.count(F.lit(1)).alias("degree"))
    own = (F.col("node") == F.col("a")) & (F.col("kind") == F.col("d_kind"))
    seeds = stored(
        seeds.join(degrees.select(F.col("kind").alias("d_kind"), "a", "degree"), own, "left").select("kind", "node", "seed", F.coalesce("degree", F.lit(0)).alias("degree")), "seeds"
    )
    salts = F.expr(f"cast(1 + degree div {crowded} as int)")
    many = seeds.filter(salts > 1).select(F.col("kind").alias("m_kind"), F.col("node").alias("m_node"), salts.alias("salts"))
    steps = both.join(many, (F.col("kind") == F.col("m_kind")) & (F.col("a") == F.col("m_node")), "left")
    steps = stored(steps.select("kind", "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")), "steps")
    state = seeds.withColumn("mass", F.col("seed"))
    while True:
        share = F.expr("mass div degree")
        sending = state.filter("mass > 0 AND degree > 0").select(
            F.col("kind").alias("s_kind"), F.col("node").alias("s_node"), share.alias("sent"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("s_salt")
        )
        sent = sending.join(steps, (F.col("s_kind") == F.col("kind")) & (F.col("s_node") == F.col("a")) & (F.col("s_salt") == F.col("salt"))).select("kind", F.col("b").alias("node"), "sent")
        none = F.lit(0).cast("long")
        kept = state.select("kind", "node", "seed", "degree", "mass", F.when(F.col("degree") == 0, F.col("mass")).otherwise(none).alias("sent"))
        after = (
            kept.unionAll(sent.select("kind", "node", none.alias("seed"), none.alias("degree"), none.alias("mass"), "sent"))
            .groupBy("kind", "node")
            .agg(*[F.sum(c).alias(c) for c in ("seed", "degree", "mass", "sent")])
            .select("kind", "node", "seed", "degree", F.expr("(15 * seed + 85 * sent) div 100").alias("mass"), F.col("mass").alias("before"))
        )
        after = stored(after, "masses")
        if "before" in state.columns:
            dropped(state)
        state = after
        if (state.agg(F.sum(F.abs(F.col("mass") - F.col("before")))).first()[0] or 0) <= settled:
            break
    mass = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(F.lit(0)))
    return state.groupBy(F.col("node").alias("host")).agg(mass("t").alias("trust"), mass("d").alias("distrust"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = 1.0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust.

    * a null url, or one without "://", has empty host and path, fits no rule and is
      allowed; a null html has no links, long ones are read whole; repeated rows and null
      ids are judged each; of rules of one length the smaller fits first;
    * ``rules`` is a configuration list held in the plan, longest match first;
    * trust and distrust are the host's mass for each page over the average (null for
      an empty host); no rows in, no rows out; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).select(
        "id", "html", host.alias("host"), path.alias("path")
    )
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    slim = stored(named.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "urls")
    hosts = stored(
        slim.filter("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("ruled") == "allow").alias("allowed"),
            F.count_if(F.col("ruled") == "block").alias("blocked"),
        ),
        "hosts",
    )
    masses = propagate(hosts, host_edges(named, hosts))
    total = hosts.agg(F.sum("pages")).first()[0] or 1
    density = lambda c: F.col(c) / F.lit(float(MASS)) * F.lit(float(total)) / F.col("pages")
    scores = (
        hosts.join(masses, "host", "left")
        .na.fill(0, ["trust", "distrust"])
        .select(F.col("host").alias("h"), density("trust").alias("trust"), density("distrust").alias("distrust"))
    )
    by_host = F.when(F.col("distrust") - F.col("trust") > F.lit(float(threshold)), F.lit("block")).otherwise(F.lit("allow"))
    # A host may have a third of all pages: its pages are dealt over salts, its one score
    # row is sent to each of them.
    dealt = slim.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    sent = scores.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(sent, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("h_salt")), "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust"
    )
