"""URL filters: host and path rules, and propagation of trust and distrust over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, looked_up, materialise, quoted, with_totals

#: (verdict, host, path); a rule fits its host and all subdomains of it.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Share of a host's score that goes on to its neighbours; rounds between checkpoints.
DAMPING, ROUNDS = 0.6, 8
#: Weight of the link between a host and its domain, where a hyperlink counts 1.
DOMAIN_WEIGHT = 0.25
#: A host is blocked if more than this share of its plain rank is distrust (and distrust outweighs trust).
BLOCK_SHARE = 0.25
SCORES = ("trust", "distrust", "rank")
#: What a settled walk may still have to come, as a share of the smallest seed; and the wider margin within which a host is at the threshold, not above it.
TOLERANCE, MARGIN = 1e-5, 1e-4
#: Links of one host that one task follows.
ARC_ROWS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; '' without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | F.endswith(host, F.lit("." + rule_host))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(host, of) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(found)
    return found


def domain_of(host: Column) -> Column:
    """The last two labels of a host; '' of one that has no more than these, or that is a number."""
    return F.when(host.rlike(r"[.][0-9]+(:[0-9]*)?$"), F.lit("")).otherwise(F.regexp_extract(host, r"[^.][.]([^.]+[.][^.]+)$", 1))


def host_edges(pages: DataFrame, html: str = "html", domain_weight: float = DOMAIN_WEIGHT) -> DataFrame:
    """(src, dst, n): hyperlinks between different hosts, n of them, and both ways between each host with pages and its domain, of ``domain_weight``.

    Relative links stay on their host and count for nothing. Beside hyperlinks the domain's weight is small; hosts without any give all they have to it.
    """
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(F.expr(f"""regexp_extract_all(coalesce({quoted(html)}, ''), r'(?i)href\\s*=\\s*["\\x27]?((?:https?:)?//[^"\\x27\\s>]+)', 1)""")).alias("_url"),
    )
    links = links.select("src", host_of(F.when(F.startswith("_url", F.lit("//")), F.concat(F.lit("http:"), F.col("_url"))).otherwise(F.col("_url"))).alias("dst"))
    up = pages.select(F.col("host").alias("src"), domain_of(F.col("host")).alias("dst")).distinct().withColumn("n", F.lit(domain_weight))
    every = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")).unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return every.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _arcs(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, deal, dst, fan, ahead, back, own): shares along the links, and against them with src and dst swapped; own is 1 from a host to itself.

    The arcs of a host are dealt over its ``fan`` tasks, of ARC_ROWS arcs each; here ``fan`` is that of dst.
    """
    weight = {"_all": (F.sum("n"), F.sum)}
    zero = F.lit(0.0)
    forward = with_totals(edges, ["src"], "dst", weight).select("src", "dst", (F.col("n") / F.col("_all")).alias("ahead"), zero.alias("back"))
    backward = with_totals(edges, ["dst"], "src", weight).select(F.col("dst").alias("src"), F.col("src").alias("dst"), zero.alias("ahead"), (F.col("n") / F.col("_all")).alias("back"))
    every = hosts.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    stay = every.select(F.col("host").alias("src"), F.col("host").alias("dst"), zero.alias("ahead"), zero.alias("back"), F.lit(1.0).alias("own"))
    arcs = forward.unionByName(backward).groupBy("src", "dst").agg(F.sum("ahead").alias("ahead"), F.sum("back").alias("back")).withColumn("own", zero)
    arcs = cut(with_totals(arcs.unionByName(stay), ["src"], "dst", {"_fan": (F.count("*"), F.sum)}).withColumn("_fan", F.ceil(F.col("_fan") / ARC_ROWS).cast("int")))
    fans = arcs.where("own = 1").select("dst", F.col("_fan").alias("fan"))
    return cut(looked_up(arcs, fans, ["dst"], "src", "inner").select("src", F.pmod(F.hash("dst"), F.col("_fan")).alias("deal"), "dst", "fan", "ahead", "back", "own"))


def _moved(scores: DataFrame, arcs: DataFrame, damping: float) -> DataFrame:
    """One step of the walk on: what each host gets now (step_*), and all that it got so far."""
    dealt = scores.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    met = dealt.join(arcs, (F.col("host") == F.col("src")) & (F.col("_deal") == F.col("deal")))
    got = {c: damping * F.sum(F.col(f"step_{c}") * F.col(share)) for c, share in zip(SCORES, ("ahead", "back", "ahead"), strict=True)}
    return met.groupBy(F.col("dst").alias("host")).agg(
        F.max("fan").alias("fan"), *[x.alias(f"step_{c}") for c, x in got.items()], *[(F.sum(F.col(c) * F.col("own")) + x).alias(c) for c, x in got.items()]
    )


def settle(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank per host, run until it is settled: (host, trust, distrust, rank).

    ``seeds`` has host, trust, distrust and rank (start weights). Trust and rank follow the links, distrust runs
    against them. Hosts that only links name take part with seeds of 0.

    The scores are the sum of all steps of the walk, which begins with (1 - damping) * seed. It ends when all that is still
    to come, for all hosts together, is at most ``tolerance`` of the smallest seed of rank: then every host with a page of its
    own has its scores to within ``tolerance`` / (1 - damping) of its rank. A step's mass shrinks by ``damping`` at least, so
    the rounds grow with the logarithm of the seeds' mass only; where links make no circles the walk ends by itself. Each round is one
    join on the host and one sum per host; a host of very many links is dealt over tasks.
    """
    seeds = cut(seeds.select("host", *SCORES))
    arcs = _arcs(edges, seeds)
    least, mass = seeds.agg(F.min(F.when(F.col("rank") > 0, F.col("rank"))), F.sum(F.greatest(*SCORES))).first()
    enough = tolerance * (least or mass or 0.0) * (1 - damping) / damping
    first = {c: (1 - damping) * F.coalesce(F.col(c), F.lit(0.0)) for c in SCORES}
    scores = arcs.where("own = 1").select(F.col("dst").alias("host"), "fan").join(seeds, "host", "left")
    scores = scores.select("host", "fan", *[x.alias(f"step_{c}") for c, x in first.items()], *[x.alias(c) for c, x in first.items()])
    while True:
        for _ in range(ROUNDS):
            scores = _moved(scores, arcs, damping)
        scores = cut(scores)
        left = scores.agg(*[F.coalesce(F.sum(f"step_{c}"), F.lit(0.0)) for c in SCORES]).first()
        if max(left) <= enough:
            return scores.select("host", *SCORES)


def _bad(block_share: float) -> str:
    """Whether a host's distrust exceeds its trust and ``block_share`` of its rank."""
    return f"distrust > (1 + {MARGIN!r}) * trust AND distrust > {block_share!r} * (1 + {MARGIN!r}) * rank"


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", block_share: float = BLOCK_SHARE) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and the host's scores.

    A fitting rule decides. For other pages the host does: its pages that rules allow or block are the seeds of
    trust and distrust, all its pages those of the plain rank, and the host is blocked if its distrust exceeds its trust and ``block_share`` of
    its rank, all of them settled: if so large a share of the pages on it, on what it links to and beside it in the domain is blocked.
    Null urls have an empty host, which links to nothing and is allowed; very long urls and repeated pages are as others. Columns named like the results are replaced, other columns may have any names.
    """
    pages = pages.drop("host", "path", "rule", "verdict", *SCORES)
    kept = [F.col(quoted(c)) for c in pages.columns]
    parsed = pages.select(*kept, host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"))
    found = fresh(parsed, "_rule")
    ruled = parsed.withColumn(found, rule_for(F.col("host"), F.col("path"), rules))
    per_host = ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col(f"{found}.verdict") == "allow", 1)).cast("double").alias("trust"),
        F.count(F.when(F.col(f"{found}.verdict") == "block", 1)).cast("double").alias("distrust"),
        F.count("*").cast("double").alias("rank"),
    )
    per_host = materialise(per_host, "hosts")
    bad = fresh(parsed, "_bad")
    scores = settle(per_host, materialise(host_edges(parsed, html), "links")).select("host", *SCORES, F.expr(_bad(block_share)).alias(bad))
    judged = looked_up(ruled, scores, ["host"], url)
    by_host = F.when(F.coalesce(F.col(bad), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        *kept, "host", "path", F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.verdict"), by_host).alias("verdict"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in SCORES],
    )


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = 60, damping: float = DAMPING, domain_weight: float = DOMAIN_WEIGHT, block_share: float = BLOCK_SHARE) -> str:
    """DuckDB SQL of page_id, host, path, rule and verdict; after ``rounds`` rounds nothing is left to come."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{(r[0], r[1] + r[2])[k]}'" for r in ordered) + " END"
    return f"""
    WITH RECURSIVE parsed AS MATERIALIZED (
        SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    ruled AS MATERIALIZED (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS ruling FROM parsed),
    links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["\\x27]?((?:https?:)?//[^"\\x27\\s>]+)', 1)) AS link FROM parsed),
    domains AS (SELECT DISTINCT host, regexp_extract(host, '[^.][.]([^.]+[.][^.]+)$', 1) AS domain FROM parsed WHERE NOT regexp_matches(host, '[.][0-9]+(:[0-9]*)?$')),
    edges AS MATERIALIZED (
        SELECT src, dst, sum(n) AS n FROM (
            SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst, 1.0 AS n FROM links
            UNION ALL SELECT host, domain, {domain_weight} FROM domains UNION ALL SELECT domain, host, {domain_weight} FROM domains)
        WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
    arcs AS MATERIALIZED (
        SELECT src, dst, sum(ahead) AS ahead, sum(back) AS back FROM (
            SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS ahead, 0.0 AS back FROM edges
            UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM edges) GROUP BY 1, 2),
    seeds AS MATERIALIZED (SELECT host, CAST(count(*) FILTER (ruling = 'allow') AS DOUBLE) AS trust, CAST(count(*) FILTER (ruling = 'block') AS DOUBLE) AS distrust,
                     CAST(count(*) AS DOUBLE) AS rank FROM ruled WHERE host <> '' GROUP BY 1),
    walk AS (
        SELECT 0 AS k, host, {1 - damping!r} * trust AS trust, {1 - damping!r} * distrust AS distrust, {1 - damping!r} * rank AS rank FROM seeds
        UNION ALL
        SELECT max(k) + 1, a.dst, {damping!r} * sum(w.trust * a.ahead), {damping!r} * sum(w.distrust * a.back), {damping!r} * sum(w.rank * a.ahead)
        FROM walk w JOIN arcs a ON w.host = a.src WHERE k < {rounds} GROUP BY a.dst),
    scores AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust, sum(rank) AS rank FROM walk GROUP BY 1)
    SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruling, CASE WHEN {_bad(block_share)} THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled r LEFT JOIN scores s ON r.host = s.host
    """
