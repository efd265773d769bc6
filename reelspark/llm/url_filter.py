"""Op 9, URL filters: rules first, then host reputation by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (verdict, host, path): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and for texts without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PATTERN, 1), UPPER, LOWER), F.regexp_extract(url, PATTERN, 2)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def _shrink(counts: DataFrame, parent: str, level: str) -> DataFrame:
    """Posterior means and weights of one level: counts has n, k (pages with an outcome, good ones) and the prior mean
    ``parent``. The prior's strength comes from the spread between the level's groups (one-way moments), five sums that
    are one row for the driver."""
    part = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.try_divide(F.col("k"), F.col("n")) - F.col(parent), 2)).otherwise(0.0))
    s, total, squares, groups, binomial = counts.agg(
        part,
        F.sum("n"),
        F.sum(F.col("n") * F.col("n")),
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))),
    ).first()
    rho = 0.01
    if total and binomial and (spare := total - squares / total - (groups - 1)):
        rho = (s / (binomial / total) - (groups - 1)) / spare
    rho = min(0.5, max(0.001, rho))
    strength = (1 - rho) / rho
    a, b = strength * F.col(parent) + F.col("k"), strength * (1 - F.col(parent)) + F.col("n") - F.col("k")
    return counts.withColumns({f"{level}_mean": a / (a + b), f"{level}_weight": a + b})


def _registered(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Adds suffix and domain (the suffix and one label more) to rows of ``host``."""
    labels = F.split("host", r"\.")
    last = lambda n: F.substring_index("host", ".", -n)
    if suffixes is None:
        many = last(2).isin(*TWO_LABEL_SUFFIXES)
        return hosts.withColumns({"suffix": F.when(many, last(2)).otherwise(last(1)), "domain": F.when(many, last(3)).otherwise(last(2))})
    known = suffixes.select(F.lower("suffix").alias("known")).where("known is not null").distinct()
    tails = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("size"))
    tails = tails.withColumn("known", F.expr("substring_index(host, '.', -size)")).join(known, "known")
    longest = tails.groupBy("host").agg(F.max("size").alias("size"))
    size = F.coalesce("size", F.lit(1))
    cut = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n))
    return hosts.join(longest, "host", "left").withColumns({"suffix": cut(size), "domain": cut(size + 1)}).drop("size")


def host_reputation(pages: DataFrame, host: str = "host", outcome: str = "outcome", suffixes: DataFrame | None = None) -> DataFrame:
    """One row for each host: n_labelled, n_good, and mean and weight of its beta posterior, with priors that go from
    all pages to suffix, registered domain and host.

    pages: ``host`` (string), ``outcome`` (1 good, 0 bad, null unlabelled). suffixes: ``suffix``, the public suffixes of
    any number of labels; the longest one counts, and the last label where none fits; None stands for a short list of
    two labels. Null hosts count as ''. An empty table gives no rows; without any outcome all posteriors are near 1/2.
    Hot hosts are summed before the shuffle; one row a host, one a domain and one a suffix are stored once each."""
    hosts = pages.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(
        F.count(outcome).alias("n"), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0)).alias("k")
    )
    hosts = stored(_registered(hosts, suffixes), "hosts")
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = stored(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    by_suffix = stored(domains.groupBy("suffix").agg(*sums), "suffixes")
    n, k = by_suffix.agg(*sums).first()
    by_suffix = _shrink(by_suffix.withColumn("root_mean", F.lit(((k or 0) + 1) / ((n or 0) + 2))), "root_mean", "suffix").select("suffix", "suffix_mean")
    domains = _shrink(domains.join(by_suffix, "suffix"), "suffix_mean", "domain").select("suffix", "domain", "domain_mean")
    return _shrink(hosts.join(domains, ["suffix", "domain"]), "domain_mean", "host").select(
        "host", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), "host_mean", "host_weight"
    )


def url_filter(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, z: float = 1.645, floor: float = 0.5, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule, verdict, n_labelled, n_good, host_mean and host_bound to every row of ``pages``.

    The longest rule that fits decides (of equal length: the first in ``rules``). Pages that a rule decides are the
    labelled outcomes; all other pages take the posterior of their host: allowed where the lower bound
    ``mean - z * sd`` of the good share reaches ``floor``, blocked otherwise. Hosts without outcomes of their own have
    the bound of their domain's and suffix's prior, so they stay where their kin is good. Null or malformed URLs have
    empty host and path, fit no rule and take the posterior of the empty host; URLs of any length are taken whole.
    Rows are kept one to one, repeated ones too; columns of those names in ``pages`` are replaced; an empty table gives
    no rows. suffixes: as in ``host_reputation``. DataFrame functions only."""
    h, p = url_parts(F.col(url))
    out = pages.drop("n_labelled", "n_good", "host_mean", "host_bound").withColumns({"host": h, "path": p})
    best = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(best):
        fits = _fits(F.col("host"), F.col("path"), r)
        rule, said = F.when(fits, r[1] + r[2]).otherwise(rule), F.when(fits, r[0]).otherwise(said)
    out = out.withColumns({"rule": rule, "verdict": said})
    outcomes = out.select("host", F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", 0).alias("outcome"))
    bound = F.col("host_mean") - z * F.sqrt(F.col("host_mean") * (1 - F.col("host_mean")) / (F.col("host_weight") + 1))
    # one row a host; Spark broadcasts it only where its measured size is under the threshold, else hot hosts are split
    return (
        out.join(host_reputation(outcomes, suffixes=suffixes), "host", "left")
        .withColumn("host_bound", bound)
        .withColumn("verdict", F.coalesce("verdict", F.when(F.col("host_bound") < floor, "block").otherwise("allow")))
        .drop("host_weight")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_good", F.round("host_bound", 6).alias("host_bound"))


def _level(name: str, counts: str, parent: str, keys: str) -> str:
    """The SQL of one shrinking step."""
    return f"""
{name}_fit AS (SELECT sum(CASE WHEN n > 0 THEN n * pow(k / n - {parent}, 2) ELSE 0 END) s, sum(n) total, sum(n * n) squares,
  count(*) FILTER (n > 0) g, sum(n * {parent} * (1 - {parent})) / sum(n) m FROM {counts}),
{name}_m AS (SELECT (1 - rho) / rho st FROM (SELECT least(0.5, greatest(0.001, coalesce(CASE WHEN m > 0 THEN
  (s / m - (g - 1)) / nullif(total - squares / total - (g - 1), 0) END, 0.01))) rho FROM {name}_fit)),
{name}_post AS (SELECT {keys}, n, k, st * {parent} + k a, st * (1 - {parent}) + n - k b FROM {counts}, {name}_m)"""


SQL = rf"""
WITH parts AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 1.0::DOUBLE WHEN rule IS NOT NULL THEN 0.0::DOUBLE END AS good FROM ruled),
hosts AS (SELECT host, count(good)::DOUBLE n, coalesce(sum(good), 0)::DOUBLE k, array_to_string(string_split(host, '.')[-2:], '.') two,
    array_to_string(string_split(host, '.')[-3:], '.') three, string_split(host, '.')[-1] one FROM judged GROUP BY host),
host0 AS (SELECT *, CASE WHEN two IN {TWO_LABEL_SUFFIXES} THEN two ELSE one END suffix,
    CASE WHEN two IN {TWO_LABEL_SUFFIXES} THEN three ELSE two END domain FROM hosts),
dom0 AS (SELECT suffix, domain, sum(n) n, sum(k) k FROM host0 GROUP BY ALL),
suf0 AS (SELECT suffix, sum(n) n, sum(k) k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM dom0) p FROM dom0 GROUP BY suffix),
{_level("suf", "suf0", "p", "suffix")},
dom1 AS (SELECT dom0.*, a / (a + b) p FROM dom0 JOIN suf_post USING (suffix)),
{_level("dom", "dom1", "p", "suffix, domain")},
host1 AS (SELECT host0.host, host0.n, host0.k, a / (a + b) p FROM host0 JOIN dom_post USING (suffix, domain)),
{_level("host", "host1", "p", "host")}
SELECT page_id, host, path, rule, CASE WHEN good = 1 THEN 'allow' WHEN good = 0 THEN 'block'
    WHEN bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS n_labelled, k::BIGINT AS n_good, round(bound, 6) AS host_bound
FROM judged JOIN (SELECT *, a / (a + b) - 1.645 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS bound FROM host_post) USING (host)
"""
