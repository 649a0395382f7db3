"""URL filters (7): rules by host and path, and trust that spreads over links between hosts.

Where no rule fits, the host decides. Trust is a personalised PageRank from hosts that rules mostly
allow; distrust is one over the reversed links from hosts that rules mostly block, so it reaches those
that link to them. Edges between hosts are counted once, before any iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import discard, table, written

# The rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
# The iteration ends when no score moves by more than TOLERANCE, or fails after ROUNDS.
TOLERANCE = 1e-9
ROUNDS = 200
# Distrust must exceed trust by this much of one seed's share.
MARGIN = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_and_verdict(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n: links between different hosts. Links without a host stay on theirs."""
    target = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""), F.lit(1))
    rows = pages.select(host_and_path(F.col("url"))[0].alias("source"), F.explode(target).alias("t"))
    return (
        rows.select("source", F.translate("t", UPPER, LOWER).alias("target"))
        .filter("source <> '' and target <> '' and source <> target")
        .groupBy("source", "target").agg(F.count("*").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """kind, host, score: personalised PageRank of each kind of seed over the links of that kind.

    links: kind, source, target, n. seeds: kind, host. The restart is even over a kind's seeds, and
    the score of a host without links goes back to them. Scores are in shares of one seed.
    """
    spark = links.sparkSession
    totals = links.groupBy("kind", "source").agg(F.sum("n").alias("all"))
    edges, edge_path = written(links.join(totals, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("all")).alias("share")))
    outgoing = edges.select("kind", F.col("source").alias("host")).distinct().withColumn("linked", F.lit(True))
    places = edges.select("kind", F.col("target").alias("host")).union(edges.select("kind", "source")).union(seeds.select("kind", "host")).distinct()
    start = places.join(seeds.select("kind", "host").distinct().withColumn("seed", F.lit(1.0)), ["kind", "host"], "left").join(outgoing, ["kind", "host"], "left")
    nodes, node_path = written(start.select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("linked", F.lit(False)).alias("linked")))
    count = {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.sum("seed").alias("n")).collect()}
    now, path = written(nodes.select("kind", "host", F.col("seed").alias("score")))
    for _ in range(ROUNDS):
        # What hosts without links hold goes back to the seeds: one number a kind.
        loose = {r["kind"]: r["x"] for r in now.join(nodes.filter("not linked"), ["kind", "host"]).groupBy("kind").agg(F.sum("score").alias("x")).collect()}
        back = F.lit(0.0)
        for kind, n in count.items():
            if n:
                back = F.when(F.col("kind") == kind, F.lit(loose.get(kind, 0.0) / n)).otherwise(back)
        moved = (
            now.join(edges.withColumnRenamed("source", "host"), ["kind", "host"])
            .groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        )
        after = (
            nodes.join(moved, ["kind", "host"], "left").join(now, ["kind", "host"])
            .select(
                "kind", "host",
                (F.col("seed") * (1 - damping + damping * back) + damping * F.coalesce("got", F.lit(0.0))).alias("score"),
                F.col("score").alias("before"),
            )
        )
        new, new_path = written(after)
        change = new.agg(F.max(F.abs(F.col("score") - F.col("before"))).alias("d")).first()["d"] or 0.0
        discard(spark, path)
        now, path = new.select("kind", "host", "score"), new_path
        if change <= TOLERANCE:
            discard(spark, edge_path, node_path)
            return now
    raise RuntimeError(f"scores still move by {change} after {ROUNDS} rounds")


def verdicts(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust per row.

    Without a rule a page is blocked when its host's distrust exceeds its trust; hosts that neither
    reaches, and urls without a host, are allowed. Null urls have empty host and path. Repeated rows repeat.
    """
    rows = judged(pages, rules)
    counts = rows.filter("host <> ''").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("a"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"))
    kinds = F.when(F.col("a") > F.col("b"), "trust").when(F.col("b") > F.col("a"), "distrust")
    seeds, _ = written(counts.select(kinds.alias("kind"), "host").filter("kind is not null"))
    ahead = host_links(pages)
    both = ahead.select(F.lit("trust").alias("kind"), "source", "target", "n").union(
        ahead.select(F.lit("distrust"), F.col("target"), F.col("source"), "n")
    )
    scores = spread(both, seeds)
    of = lambda k: F.coalesce(F.round(F.max(F.when(F.col("kind") == k, F.col("score"))), 9), F.lit(0.0))
    hosts = scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    own = F.when(F.col("distrust") > F.col("trust") + MARGIN, "block").otherwise("allow")
    return rows.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")
