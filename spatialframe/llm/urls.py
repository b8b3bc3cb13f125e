"""URL filters: rules by host and path, and personalised PageRank over host links where no rule fits.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and goes against them, to
the hosts that link there. Mass is pushed on until no host receives more than ``tolerance`` times the least seed, however many links away
that is. A host is blocked when its distrust exceeds ``threshold`` times its trust; a host that neither reaches
is allowed. Only DataFrame functions are used.

A null url, or one without ``://``, has an empty host and path: no rule fits and the verdict is that of the empty host, which has no
links. Repeated pages count as often as they occur. Links of null html are none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spatialframe.functions.durable import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute or protocol-relative targets of anchors.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""

#: (verdict, host, path) of the contract, as fixed values.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits. Rules are a short literal list."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(c, F.lit(v)) for c, v in zip(fits, values)])
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of one host that link to another host."""
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))))
    return (pages.where(F.col("host") != "").select(F.col("host").alias("src"), to.alias("dst"))
            .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(seeds: DataFrame, links: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-3, write_every: int = 5) -> DataFrame:
    """(host, trust, distrust). ``seeds``: (host, way, weight) with the weights of a way adding up to one; way 0 follows
    links and way 1 goes against them. Both run in one join per step, which moves on what the last step brought: a host that received less than
    ``tolerance`` times the least seed of its way keeps it, a mass without a link ends, and the steps end when nothing moves."""
    edges = links.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(links.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = edges.groupBy("way", "a").agg(F.sum("n").alias("all"))
    edges = scratch.keep(edges.join(out, ["way", "a"]).select("way", "a", "b", (F.col("n") / F.col("all")).alias("p")), "edges")
    least = seeds.groupBy("way").agg((F.min("weight") * (1 - damping) * tolerance).alias("least"))
    moved = scratch.keep(seeds.join(least, "way").select("way", "host", (F.col("weight") * (1 - damping)).alias("score"), "least"), "moved0")
    scores, waiting, step = None, ["moved0"], 0
    brought = [moved]
    while not moved.isEmpty():
        step += 1
        live = moved.where("score >= least").select(F.col("way").alias("w"), "host", "score", "least")
        pushed = live.join(edges, (F.col("w") == F.col("way")) & (F.col("host") == F.col("a")))
        pushed = pushed.select("way", F.col("b").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"), "least")
        moved = scratch.keep(pushed.groupBy("way", "host").agg(F.sum("score").alias("score"), F.first("least").alias("least")), f"moved{step}")
        brought.append(moved)
        waiting.append(f"moved{step}")
        if step % write_every == 0:
            scores = scratch.keep(_total(brought, scores), "scores")
            scratch.drop(*waiting[:-1])
            brought, waiting = [], waiting[-1:]
    side = lambda k: F.sum(F.when(F.col("way") == k, F.col("score")).otherwise(0.0))
    return _total(brought, scores).groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def _total(brought: list[DataFrame], scores: DataFrame | None) -> DataFrame:
    parts = [b.select("way", "host", "score") for b in brought] + ([scores] if scores is not None else [])
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    return both.groupBy("way", "host").agg(F.sum("score").alias("score"))


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = 1.0, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page."""
    scratch = Scratch(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "__v": verdict})
    way = F.when(F.col("__v") == "allow", 0).otherwise(1)
    marked = ruled.where("__v is not null").groupBy("host", way.alias("way")).agg(F.count(F.lit(1)).alias("n"))
    total = marked.groupBy("way").agg(F.sum("n").alias("all"))
    seeds = scratch.keep(marked.join(total, "way").select("way", "host", (F.col("n") / F.col("all")).alias("weight")), "seeds")
    scores = propagate(seeds, scratch.keep(host_links(base), "links"), scratch, damping, tolerance)
    bad = scratch.keep(scores.where(F.col("distrust") > threshold * F.col("trust")).select(F.col("host").alias("__h"), F.lit(True).alias("__bad")), "blocked")
    scratch.close("blocked")
    return (ruled.drop("html").join(bad, F.col("host") == F.col("__h"), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("__v", F.when(F.col("__bad"), "block").otherwise("allow")).alias("verdict")))


def oracle_sql(rules=RULES, damping: float = 0.85, tolerance: float = 1e-3) -> str:
    """The same rules and pushes for DuckDB, the pushes as a recursion."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fit = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    case = lambda value: "case " + " ".join(f"when {fit(h, p)} then '{value((v, h, p))}'" for v, h, p in ordered) + " end"
    link = LINK.replace("'", "''")
    return f"""with recursive base as (select page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
    ruled as (select page_id, host, path, {case(lambda r: r[1] + r[2])} rule, {case(lambda r: r[0])} v from base),
    marked as (select host, case when v = 'allow' then 0 else 1 end way, count(*) n from ruled where v is not null group by all),
    seeds as (select way, host, n / sum(n) over (partition by way) weight from marked),
    links as (select src, dst, count(*) n from (select host src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: translate(h, '{UPPER}', '{LOWER}')))) dst
        from base where host <> '') where src <> dst group by all),
    both_ways as (select 0 way, src a, dst b, n from links union all select 1, dst, src, n from links),
    edges as (select way, a, b, n / sum(n) over (partition by way, a) p from both_ways),
    moved as (select way, host, weight * {1 - damping} score, min(weight) over (partition by way) * {(1 - damping) * tolerance} least from seeds
        union all select e.way, e.b, sum(m.score * e.p * {damping}), min(m.least) from moved m join edges e on m.way = e.way and m.host = e.a where m.score >= m.least group by e.way, e.b),
    bad as (select host from moved group by host having sum(case when way = 1 then score else 0 end) > sum(case when way = 0 then score else 0 end))
    select page_id, host, path, rule, coalesce(v, case when host in (select host from bad) then 'block' else 'allow' end) verdict from ruled"""
