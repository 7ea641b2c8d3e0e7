"""URL filters by rules and empirical-Bayes host reputation (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
INLINE_RULES = 1000  # rules that are matched inside the row; more are joined


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def _suffixes(host: Column) -> Column:
    """A host and all its parent domains."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))


def longest_rule(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages (host, path, ...)`` with ``rule`` and ``action`` of the longest rule that fits, else null.

    A short list of rules is looked up inside the row. A longer one is joined with
    the distinct hosts and their parents, so rows meet rules by equal host only.
    """
    parts = [(r[: r.index("/")], r[r.index("/") :], r, a) for r, a in rules if "/" in r]
    fits = lambda r: F.startswith(F.col("path"), r["rule_path"])
    best = lambda found: F.array_max(F.transform(F.filter(found, fits), lambda r: F.struct(F.length(r["rule"]), r["rule"], r["action"])))
    if len(parts) <= INLINE_RULES:
        by_host: dict[str, list] = {}
        for h, p, rule, action in parts:
            by_host.setdefault(h, []).append(F.struct(F.lit(p).alias("rule_path"), F.lit(rule).alias("rule"), F.lit(action).alias("action")))
        if not by_host:
            return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
        known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*rs))])
        empty = F.array().cast("array<struct<rule_path:string,rule:string,action:string>>")
        found = F.flatten(F.transform(_suffixes(F.col("host")), lambda s: F.coalesce(F.try_element_at(known, s), empty)))
        joined = pages.withColumn("found", found)
    else:
        table = pages.sparkSession.createDataFrame(parts, "suffix string, rule_path string, rule string, action string")
        hosts = pages.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
        lists = hosts.join(table, "suffix").groupBy("host").agg(F.collect_list(F.struct("rule_path", "rule", "action")).alias("found"))
        joined = pages.join(lists, "host", "left")
    return joined.withColumn("best", best(F.col("found"))).select(
        *pages.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action")
    )


_LEVELS = ("suffix", "domain", "host")


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of good pages per host: ``(host, alpha, beta, upper)``, one row for each host of ``pages``.

    ``pages (page_id, host)``, ``outcomes (page_id, good)``. Outcomes are counted per
    host, and from those per registered domain (the last two labels) and suffix (the last
    label). Going down, each node starts from a beta prior with its parent's posterior mean
    and a strength fitted to its level by the method of moments of the beta-binomial: the
    more nodes of one parent differ beyond chance, the weaker. Hosts without outcomes have
    their parent's mean. All sums are by host first, so a hot host is one row afterwards.
    """
    good = outcomes.select(F.col("page_id").alias("outcome_id"), F.col("good").cast("double").alias("good"))
    joined = pages.join(good, F.col("page_id") == F.col("outcome_id"), "left")
    labels = F.split("host", r"\.", -1)
    nodes = joined.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
    nodes = nodes.select(
        "*",
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"),
    )
    total = F.sum("n").alias("n"), F.sum("g").alias("g")
    tables = {"host": nodes, "domain": nodes.groupBy("domain", "suffix").agg(*total), "suffix": nodes.groupBy("suffix").agg(*total)}
    mean = nodes.agg(F.coalesce(F.try_divide(F.sum("g"), F.sum("n")), F.lit(0.5)).alias("prior"))
    above, key = mean, None
    for level in _LEVELS:
        table = tables[level]
        table = table.join(above, key) if key else table.crossJoin(F.broadcast(above))  # one row
        rate = F.try_divide("g", "n")
        spread = F.sum(F.col("n") * F.pow(rate - F.col("prior"), 2))
        chance = F.sum(F.when(F.col("n") > 0, F.col("prior") * (1 - F.col("prior"))))
        own = F.sum("n") - F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n"))
        fit = table.agg(spread.alias("s"), chance.alias("c"), own.alias("o"), F.avg(F.when(F.col("n") > 0, F.col("prior") * (1 - F.col("prior")))).alias("v"))
        between = F.try_divide(F.col("s") - F.col("c"), F.col("o"))
        strength = F.when(between > 0, F.least(F.greatest(F.col("v") / between - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
        table = table.crossJoin(F.broadcast(fit.select(strength.alias("strength"))))  # one row
        alpha = F.col("strength") * F.col("prior") + F.col("g")
        beta = F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("g")
        table = table.select(*[c for c in (level, "domain", "suffix") if c in table.columns], alpha.alias("alpha"), beta.alias("beta"))
        above, key = table.select(level, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior")), level
    a, b = F.col("alpha"), F.col("beta")
    upper = a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return table.select("host", "alpha", "beta", upper.alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, least: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages (page_id, url)``.

    A rule decides where one fits. Elsewhere a page is blocked when even the upper
    bound of its host's share of good pages is below ``least``. A null url or one
    without ``://`` has an empty host and path, which form a host of their own. Rows
    without a page_id have no outcome. Repeated outcomes of one page are averaged.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    per_page = outcomes.groupBy("page_id").agg(F.avg(F.col("good").cast("double")).alias("good"))
    scored = reputation(parsed.select("page_id", "host"), per_page).select(F.col("host").alias("scored"), "upper")
    ruled = longest_rule(parsed, rules).join(scored, F.col("host") == F.col("scored"))
    verdict = F.coalesce("action", F.when(F.col("upper") < least, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _level_sql(level: str, parent: str, source: str) -> str:
    """CTE of one level: posterior parameters from counts and the parent's posterior mean."""
    keep = {"suffix": "suffix", "domain": "domain, suffix", "host": "host, domain, suffix"}[level]
    counts = f"SELECT {keep}, sum(n) AS n, sum(g) AS g FROM {source} GROUP BY {keep}"
    prior = "(SELECT coalesce(sum(g) / nullif(sum(n), 0), 0.5) FROM nodes)" if parent == "" else f"p_{parent}.mean"
    join = "" if parent == "" else f" JOIN p_{parent} USING ({parent})"
    cols = ", ".join(f"c.{k.strip()}" for k in keep.split(","))
    return f"""c_{level} AS ({counts}),
j_{level} AS (SELECT {cols}, c.n, c.g, {prior} AS prior FROM c_{level} c{join}),
f_{level} AS (SELECT (sum(CASE WHEN n > 0 THEN n * power(g / n - prior, 2) END)
    - sum(CASE WHEN n > 0 THEN prior * (1 - prior) END))
    / nullif(sum(n) - sum(n * n) / nullif(sum(n), 0), 0) AS between_var,
  avg(CASE WHEN n > 0 THEN prior * (1 - prior) END) AS v FROM j_{level}),
s_{level} AS (SELECT CASE WHEN between_var > 0 THEN least(greatest(v / between_var - 1, 1.0), 1000.0) ELSE 1000.0 END AS k
  FROM f_{level}),
p_{level} AS (SELECT {keep}, k * prior + g AS a, k * (1 - prior) + n - g AS b, (k * prior + g) / (k + n) AS mean
  FROM j_{level}, s_{level})"""


def judge_sql() -> str:
    """The same rule on ``pages`` and ``labels``."""
    upper = f"translate(coalesce(regexp_extract(url, '{PATTERN}', 1), ''), '{UPPER}', '{LOWER}')"
    fits = " UNION ALL ".join(
        f"SELECT '{r[: r.index('/')]}' AS h, '{r[r.index('/') :]}' AS p, '{r}' AS rule, '{a}' AS action" for r, a in RULES
    )
    return f"""WITH parsed AS (SELECT page_id, {upper} AS host, coalesce(regexp_extract(url, '{PATTERN}', 2), '') AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, avg((quality = 1 AND toxic = 0)::INT)::DOUBLE AS good FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
nodes AS (SELECT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain,
    string_split(host, '.')[-1] AS suffix, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS g
  FROM parsed LEFT JOIN outcomes USING (page_id) GROUP BY host),
{_level_sql("suffix", "", "nodes")},
{_level_sql("domain", "suffix", "nodes")},
{_level_sql("host", "domain", "nodes")},
rules AS ({fits}),
ruled AS (SELECT p.*, (SELECT max(struct_pack(n := length(r.rule), rule := r.rule, action := r.action)) FROM rules r
    WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS best FROM parsed p)
SELECT r.page_id, r.host, r.path, best.rule AS rule,
  coalesce(best.action, CASE WHEN mean + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.5
    THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN p_host USING (host)"""
