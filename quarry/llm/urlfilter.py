"""URL filters by rules, and by link-graph propagation where no rule decides.

Every host with pages that rules allow (block) is a seed of trust (distrust), weighted by the share of
such pages among its own. Trust spreads along links between hosts, distrust against them, both as
personalised PageRank. Both are on one scale, that of the seeds' weights: the ranks of a kind sum to the weight of
its seeds, so the kind with fewer seeds has no advantage. A host whose distrust exceeds its trust by MARGIN is blocked.

DataFrame functions only. Pages are aggregated to hosts and host links before any join on hosts; links
and ranks have a row per host pair and host. Each round is written under the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

DAMPING = 0.85
ROUNDS = 1000  # a bound on what TOLERANCE needs (about 90); beyond it is an error
TOLERANCE = 1e-6  # of the summed change of a kind's ranks to their sum
MARGIN = 0.0
#: Links to other hosts: absolute or without a scheme.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased, and then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, action) from pairs like ("net/", "block")."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, a) for r, a in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, action string")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    src, _ = host_path(F.col("url"))
    found = pages.where(F.instr("html", "//") > 0).select(src.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("to"))
    dst = F.translate(F.col("to"), _UPPER, _LOWER)
    return found.select("src", dst.alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of all hosts reached; each kind sums to the weight of its seeds.
    ``links``: (src, dst, n). ``seeds``: (host, trust, distrust), weights.

    Ranks of hosts without onward links return to the seeds, which only scales the ranks of a kind; they
    are scaled to their sum at the end. Rounds go on until the summed change of each kind is at most ``tolerance`` of
    its sum, hosts reached for the first time included; RuntimeError if ``rounds`` are not enough."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    step = written(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out") * DAMPING).alias("w")), "links")
    flat = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "x")).where("x > 0")
    total = flat.groupBy("kind").agg(F.sum("x").alias("total"))
    start = written(flat.join(total, "kind").select("kind", "host", (F.col("x") / F.col("total")).alias("x")), "seeds")
    rank = start.select("kind", "host", (F.col("x") * (1 - DAMPING)).alias("x"))
    if not step.isEmpty():
        for _ in range(rounds):
            moved = rank.join(step, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
            new = moved.unionByName(start.withColumn("x", F.col("x") * (1 - DAMPING))).groupBy("kind", "host").agg(F.sum("x").alias("x"))
            new = new.join(rank.withColumnRenamed("x", "old"), ["kind", "host"], "full").select(
                "kind", "host", F.coalesce("x", F.lit(0.0)).alias("x"), F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("change"))
            new = written(new, "rank")
            rank = new.select("kind", "host", "x")
            moving = new.groupBy("kind").agg(F.sum("change").alias("c"), F.sum("x").alias("s")).where(F.col("c") > F.col("s") * tolerance)
            if moving.isEmpty():
                break
        else:
            raise RuntimeError(f"ranks still change after {rounds} rounds")
    reached = rank.groupBy("kind").agg(F.sum("x").alias("reached"))
    share = rank.join(reached.join(total, "kind"), "kind").withColumn("x", F.col("x") / F.col("reached") * F.col("total"))
    return share.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("x")).otherwise(0.0)).alias("trust"),
                                     F.sum(F.when(F.col("kind") == "distrust", F.col("x")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], margin: float = MARGIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages`` (page_id, url, html).

    ``rule``: the longest rule that fits (at equal length a blocking one, then by name), else null; ``verdict``: its
    action, else ``block`` or ``allow`` by the host's ranks (a host without any is allowed). A rule fits its host
    and all subdomains if the path starts with the rule's. Null html has no links. Rows of equal page_id are
    judged one by one.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = own.groupBy("host").agg(F.count("*").alias("pages"))
    fits = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(rules_table(spark, rules), "rule_host")
    per_host = fits.groupBy("host").agg(F.collect_list(F.struct(
        F.length("rule").alias("size"), (F.col("action") == "block").alias("blocks"), "rule", "rule_path", "action")).alias("rules"))

    def ruled(rows: DataFrame) -> DataFrame:
        best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
        return rows.join(per_host, "host", "left").withColumn("best", best).drop("rules")

    seen = ruled(own).groupBy("host").agg(
        F.count("*").alias("pages"), F.sum((F.coalesce(F.col("best.action") == "allow", F.lit(False))).cast("long")).alias("allowed"),
        F.sum((F.coalesce(F.col("best.action") == "block", F.lit(False))).cast("long")).alias("blocked"))
    seeds = seen.select("host", (F.col("allowed") / F.col("pages")).alias("trust"), (F.col("blocked") / F.col("pages")).alias("distrust"))
    ranks = written(propagate(host_links(pages), seeds), "ranks")
    out = ruled(own).join(ranks, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when(F.col("distrust") > F.col("trust") + margin, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), method).alias("verdict"), "trust", "distrust")
