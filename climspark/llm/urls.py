"""URL filters: host and path rules, and trust and distrust carried over the links between hosts.

Only DataFrame functions are used. A url's verdict is that of the longest rule that fits. Urls without a rule are judged
by their host: pages that rules allow are seeds of trust, and pages that rules block seeds of distrust. Trust is spread
along links by personalised PageRank, distrust against them (who links to blocked hosts is suspect). Both are scaled
back to pages, and a host is blocked once its distrust exceeds its trust by the threshold.

Links are reduced to weighted host edges while they are read. Each round of the ranks is one join and one aggregate
over hosts, written to the shared folder. Rounds go on, however many they are, until the ranks rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climspark.llm.common import small_side
from climspark.sources.staging import new_folder, stage

# The contract's rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

DAMPING = 0.85
# Rounds that the SQL twin writes out; the query itself does not stop at them.
ROUNDS = 20
TOLERANCE = 1e-9
# Mass that a host keeps at least once it is reached, so that none vanishes by underflow.
LEAST_MASS = 1e-300
# A host is blocked if its distrust is above this many times its trust.
THRESHOLD = 1.0
# Bytes of a host row, for the size check of the last join.
HOST_BYTES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null. A rule fits its host and all subdomains, if the
    path starts with the rule's. ``rules`` is a parameter of the plan, not a table."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    kind = "array<struct<verdict:string,host:string,path:string,rule:string>>"
    table = F.array(
        *[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule")) for v, h, p in ordered]
    ).cast(kind)
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.get(fits, F.lit(0))


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (both null without one)."""
    parts = pages.select(
        "page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path")
    )
    found = parts.withColumn("_found", longest_rule(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and n: links from one host to another. Relative links stay on their host and make no edge."""
    links = pages.select(
        host_of(F.col("url").cast("string")).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_HREF), F.lit(1))).alias("link"),
    ).filter(F.col("link").contains("//"))
    absolute = F.when(F.startswith(F.col("link"), F.lit("//")), F.concat(F.lit(":"), F.col("link"))).otherwise(F.col("link"))
    edges = links.select("src", host_of(absolute).alias("dst"))
    return edges.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def edge_shares(edges: DataFrame) -> DataFrame:
    """src, dst and share: the part of what src passes on that goes to dst."""
    totals = edges.groupBy("src").agg(F.sum("n").alias("all"))
    return stage(edges.join(totals, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")


def passed_on(shares: DataFrame, seeds: DataFrame, ranks: DataFrame, damping: float) -> DataFrame:
    """host, what it got in one round, its seed, and its mass before; 0 where it has none."""
    passed = (
        shares.join(ranks, F.col("src") == F.col("host"))
        .groupBy("dst")
        .agg((F.sum(F.col("share") * F.col("mass")) * damping).alias("got"))
    )
    rows = passed.select(F.col("dst").alias("host"), "got", F.lit(0.0).alias("seed"), F.lit(0.0).alias("mass"))
    rows = rows.unionByName(seeds.select("host", F.lit(0.0).alias("got"), "seed", F.lit(0.0).alias("mass")))
    rows = rows.unionByName(ranks.select("host", F.lit(0.0).alias("got"), F.lit(0.0).alias("seed"), "mass"))
    return rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("got", "seed", "mass")])


def personalised_rank(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """host and mass after at most ``rounds`` rounds: PageRank along ``edges`` (src, dst, n), restarting at ``seeds``
    (host, seed; the seeds sum to 1). The query takes ``resting_rank``, which has no last round.

    What a host without links would pass on goes back to the seeds.
    """
    shares = edge_shares(edges)
    seeds = stage(seeds, "seeds")
    ranks = seeds.select("host", F.col("seed").alias("mass"))
    for _ in range(rounds):
        step = stage(passed_on(shares, seeds, ranks, damping), "step")
        kept = step.agg(F.sum("got")).first()[0] or 0.0
        new = F.col("got") + F.col("seed") * (1 - kept)
        moved = step.agg(F.sum(F.abs(new - F.col("mass")))).first()[0] or 0.0
        ranks = step.select("host", new.alias("mass")).filter("mass > 0")
        if moved <= tolerance:
            break
    return ranks


def resting_rank(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """host and mass to which ``personalised_rank`` tends.

    What restarts at the seeds is the same part of every seed, so the seeds are fed in whole and the masses scaled to
    a sum of 1 at the end. They then only grow, and rest once no host's mass grew by more than ``tolerance`` of itself:
    from then on no host grows by more in any round, and none is reached that was not. Without circles that takes as
    many rounds as the longest chain; otherwise what still moves shrinks by ``damping`` a round, so the rounds end.
    """
    spark = edges.sparkSession
    shares = edge_shares(edges)
    seeds = stage(seeds, "seeds")
    ranks, last = seeds.select("host", F.col("seed").alias("mass")), None
    while True:
        folder = new_folder(spark, "step")
        passed_on(shares, seeds, ranks, damping).write.parquet(folder)
        step = spark.read.schema("host string, got double, seed double, mass double").parquet(folder)
        new = F.greatest(F.col("got") + F.col("seed"), F.lit(LEAST_MASS))
        grown, total = step.agg(F.max((new - F.col("mass")) / new), F.sum(new)).first()
        ranks = step.select("host", new.alias("mass"))
        if last:  # what this round was made from is not read again
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = folder
        if grown is None or grown <= tolerance:
            return ranks.select("host", (F.col("mass") / F.lit(total or 1.0)).alias("mass"))


def host_verdicts(pages: DataFrame, judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust and distrust (in pages) and verdict of every host that has either."""
    counts = judged.filter("verdict is not null").groupBy("host").agg(
        F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocked"),
    )
    counts = stage(counts, "counts")
    all_ = counts.agg(F.sum("allowed"), F.sum("blocked")).first()
    allowed, blocked = (float(x or 0) for x in all_)
    edges = stage(host_edges(pages), "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")

    def ranked(column: str, total: float, links: DataFrame, name: str) -> DataFrame:
        seeds = counts.filter(F.col(column) > 0).select("host", (F.col(column) / F.lit(max(total, 1.0))).alias("seed"))
        mass = resting_rank(links, seeds)
        other = "distrust" if name == "trust" else "trust"
        return mass.select("host", (F.col("mass") * total).alias(name), F.lit(0.0).alias(other))

    both = ranked("allowed", allowed, edges, "trust").unionByName(ranked("blocked", blocked, back, "distrust"))
    hosts = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    blocks = F.col("distrust") > F.col("trust") * threshold
    return hosts.withColumn("host_verdict", F.when(blocks, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host, in pages) of every row.

    A url that is null or has no ``://`` has an empty host and path. Hosts that neither trust nor distrust reaches are
    allowed, and so are those with as much of one as of the other. Repeated rows count and come out as often as they
    are. Null html has no links.
    """
    judged = judged_urls(pages, rules)
    hosts = stage(host_verdicts(pages, judged, threshold), "hosts")
    found = judged.join(small_side(hosts, hosts.count(), HOST_BYTES), "host", "left")
    return found.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op2_urls(pages: DataFrame) -> DataFrame:
    """The contract's columns of ``filter_urls``, and both scores."""
    out = filter_urls(pages)
    return out.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})
