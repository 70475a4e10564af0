"""URL filters: rules first, then an empirical-Bayes reputation of hosts, in DataFrame functions alone.

Labelled pages are good or bad outcomes of their hosts. The rate of bad pages
is shrunk from level to level: all pages give the prior of the suffixes, a
suffix that of its registered domains, a domain that of its hosts. At each
level the prior is a beta distribution whose mean is the parent's posterior
mean and whose strength comes from how far the children's rates scatter about
their parents' (method of moments over beta-binomial counts). A host is
blocked if the lower bound of its posterior rate exceeds the limit. A host
without labelled pages has its prior as its posterior, about the mean of the
nearest level that has labelled pages.

A suffix is a host's last label, or its last two where these are one of
``SUFFIXES``; a registered domain is the suffix and one label more.

Outcomes are counted per host and stored before anything is joined, so pages
are read twice: for the counts and for the verdicts. A join on hosts has a
table of one row per host on one side, so Spark can split a hot host's pages.

Edge cases: null urls and urls without "://" have an empty host and path, and
get the verdict of a host without labelled pages anywhere; hosts without a dot
are their own domain and suffix; repeated pages are judged alike, repeated
labels count each; labels without an outcome and labels of unknown pages are
ignored; of rules of equal length that fit, the last in the alphabet wins; urls
of any length are read whole; empty tables give empty results or, as outcomes,
an even prior; input columns with the names of the results are replaced, all
others stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm._common import cut, fresh, table

#: Rules of host and path, with their verdicts.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Suffixes of two labels under which domains are registered: fixed values.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.br", "com.mx", "com.ar", "com.cn", "com.tw", "com.hk", "com.sg", "com.tr", "co.za", "co.il")
#: A host is blocked if its rate of bad pages exceeds LIMIT with Z standard deviations to spare.
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's strength in pages.
WEAK, STRONG = 1.0, 10_000.0


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    start = F.length(rest) + 4
    host = F.regexp_extract(F.substr(url, start), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: the host or a subdomain of it, and a path that begins with the rule's."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        on, slash, below = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + below)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def _strength(children: DataFrame) -> float:
    """Pages' worth of a prior, from children's (n, bad, prior): how far their rates scatter beyond chance."""
    p = F.col("prior")
    got = children.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - p) ** 2).alias("scatter"),
        F.sum(p * (1 - p)).alias("chance"),
        F.sum(F.col("n") * p * (1 - p)).alias("most"),
    ).first()
    if not got["n"] or not got["most"]:
        return STRONG
    share = (got["scatter"] - got["chance"]) / max(got["most"] - got["chance"], 1e-9)
    share = min(max(share, 1 / (STRONG + 1)), 1 / (WEAK + 1))
    return round(1 / share - 1, 6)


def levels_of(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    labels = F.split(host, r"\.")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    two = (F.size(labels) > 1) & last(2).isin(*SUFFIXES)
    domain = F.when(F.size(labels) > F.when(two, 3).otherwise(2), F.when(two, last(3)).otherwise(last(2))).otherwise(host)
    return domain, F.when(two, last(2)).otherwise(F.element_at(labels, -1))


def reputations(outcomes: DataFrame) -> tuple[dict[str, DataFrame], float, float]:
    """From (host, bad): key, n and posterior mean by host, domain and suffix; all pages' rate; the strength of a host's prior.

    ``bad`` is a boolean.
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    domain, suffix = levels_of(F.col("host"))
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    levels, above = {}, None
    for level, parent, counts in (("suffix", None, hosts.groupBy("suffix").agg(*sums)), ("domain", "suffix", hosts.groupBy("domain", "suffix").agg(*sums)), ("host", "domain", hosts)):
        if parent is None:
            counts = counts.withColumn("prior", F.lit(top))
        else:
            counts = counts.join(above.select(F.col(parent), F.col("mean").alias("prior")), parent)
        counts = cut(counts)
        strength = _strength(counts)
        above = counts.withColumn("mean", (F.col("prior") * strength + F.col("bad")) / (F.lit(strength) + F.col("n")))
        levels[level] = above.select(F.col(level).alias("key"), "n", "mean")
    return levels, top, strength


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES, *, url_col: str = "url", limit: float = LIMIT, z: float = Z) -> DataFrame:
    """The pages with host, path, rule, verdict and bad_rate_bound, which replace columns of these names."""
    made = ("host", "path", "rule", "verdict", "bad_rate_bound")
    columns = [c for c in pages.columns if c.lower() not in made]
    host, path, rule, domain, suffix, *means, n = (fresh(f"_{x}", pages.columns) for x in ("host", "path", "rule", "domain", "suffix", "host_mean", "domain_mean", "suffix_mean", "n"))
    levels, top, strength = reputations(outcomes)
    pages = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    names = levels_of(F.col(host))
    pages = pages.withColumns({rule: rule_of(F.col(host), F.col(path), rules), domain: names[0], suffix: names[1]})
    for level, key, mean in zip(("host", "domain", "suffix"), (host, domain, suffix), means):
        own = [F.col("n").alias(n)] if level == "host" else []
        pages = pages.join(levels[level].select(F.col("key").alias(key), F.col("mean").alias(mean), *own), key, "left")
    mean = F.coalesce(*means, F.lit(top))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.lit(strength) + F.coalesce(n, F.lit(0)) + 1))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map().cast("map<string,string>")
    verdict = F.coalesce(F.element_at(verdicts, F.col(rule)), F.when(bound > limit, "block").otherwise("allow"))
    return pages.select(*columns, F.col(host).alias("host"), F.col(path).alias("path"), F.col(rule).alias("rule"), verdict.alias("verdict"), F.round(bound, 6).alias("bad_rate_bound"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages that a label's id names: toxic or of low quality is bad."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    marks = labels.where("toxic is not null or quality is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host <> ''")
    return hosts.join(marks, "page_id").select("host", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_url_filter: a verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(level: str, parent: str, of: str) -> str:
    """SQL of one level: its counts with the parent's mean as prior, the prior's strength, and the posterior."""
    prior = "(SELECT top FROM total)" if not parent else f"{parent}_post.mean"
    join = f" JOIN {parent}_post USING ({parent})" if parent else ""
    return f"""
{level}_prior AS (SELECT {", ".join(f"{level}_counts.{c}" for c in of.split(", "))}, {prior} AS prior FROM {level}_counts{join}),
{level}_sums AS (SELECT sum(n * power(bad / n - prior, 2)) AS scatter, sum(prior * (1 - prior)) AS chance, sum(n * prior * (1 - prior)) AS most FROM {level}_prior),
{level}_strength AS (SELECT CASE WHEN coalesce(most, 0) = 0 THEN {STRONG} ELSE round(1 / least(greatest((scatter - chance) / greatest(most - chance, 1e-9), 1 / ({STRONG} + 1)), 1 / ({WEAK} + 1)) - 1, 6) END AS strength FROM {level}_sums),
{level}_post AS (SELECT {level}, n, (prior * strength + bad) / (strength + n) AS mean FROM {level}_prior, {level}_strength)"""


_TWO = "array_to_string(list_slice(string_split({h}, '.'), -2, NULL), '.')"
_LISTED = "(" + ", ".join(f"'{x}'" for x in SUFFIXES) + ")"
_PARTS = f"""CASE WHEN {_TWO} IN {_LISTED} AND {{h}} LIKE '%.%.%.%' THEN array_to_string(list_slice(string_split({{h}}, '.'), -3, NULL), '.')
    WHEN {_TWO} NOT IN {_LISTED} AND {{h}} LIKE '%.%.%' THEN {_TWO} ELSE {{h}} END AS domain,
    CASE WHEN {_TWO} IN {_LISTED} THEN {_TWO} ELSE list_extract(string_split({{h}}, '.'), -1) END AS suffix"""
ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
parts AS (SELECT *, {_PARTS.format(h='host')} FROM named),
outcomes AS (SELECT host, CAST(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS INTEGER) AS bad FROM named JOIN labels ON page_id = doc_id WHERE host <> '' AND (toxic IS NOT NULL OR quality IS NOT NULL)),
hosts AS (SELECT host, count(*) AS n, CAST(sum(bad) AS DOUBLE) AS bad, {_PARTS.format(h='host')} FROM outcomes GROUP BY host),
total AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS top FROM hosts),
suffix_counts AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
domain_counts AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
host_counts AS (SELECT host, domain, n, bad FROM hosts),
{_level_sql("suffix", "", "suffix, n, bad")},
{_level_sql("domain", "suffix", "domain, n, bad")},
{_level_sql("host", "domain", "host, n, bad")},
ruled AS (SELECT page_id, host, path, domain, suffix, (SELECT max_by(r, length(r)) FROM (VALUES {", ".join(f"('{r}')" for r in RULES)}) AS rules(r)
    WHERE (host = split_part(r, '/', 1) OR ends_with(host, '.' || split_part(r, '/', 1))) AND starts_with(path, substr(r, instr(r, '/')))) AS rule FROM parts),
judged AS (SELECT page_id, ruled.host AS host, path, rule, coalesce(host_post.mean, domain_post.mean, suffix_post.mean, (SELECT top FROM total)) AS mean, (SELECT strength FROM host_strength) + coalesce(host_post.n, 0) AS pages
    FROM ruled LEFT JOIN host_post ON ruled.host = host_post.host LEFT JOIN domain_post ON ruled.domain = domain_post.domain LEFT JOIN suffix_post ON ruled.suffix = suffix_post.suffix)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())}
    WHEN mean - {Z} * sqrt(mean * (1 - mean) / (pages + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
