"""URL filters by empirical-Bayes host reputation.

Pages with a label give each host a count of bad outcomes. Hosts roll up to registered domains and these to
suffixes. Going down, each level's prior is a beta with the mean of its parent's posterior and a strength that the
spread of the level's own rates shows (method of moments), so a host with few labelled pages is shrunk to its domain,
and a domain to its suffix. A page is blocked where its host's bad rate exceeds `limit` by the posterior's lower
bound, mean less `bound` standard deviations. Hosts without labels have their domain's prior, and so on up.
Explicit rules on host and path come first; the longest that fits wins.

Everything is joins and aggregates with partial sums. Only the levels' moments, three numbers each, reach the driver.

Defined results: a null url, or one without ://, has empty host and path and no rule; its verdict is the empty host's.
Null labels are left out, and an id's worst outcome counts. Pages that repeat count as often as they stand. With no
labels at all the bad rate is 0 and only rules block. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import materialise, named, spread_join, table


@dataclass(frozen=True)
class Rule:
    """For a host, its subdomains, and paths that begin as given."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
# Second-level names under which countries register domains.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    # translate() lowers A to Z and nothing else
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three where a country's second level is shared."""
    labels = F.split(host, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    shared = (F.length(last) == 2) & second.isin(*SECOND)
    return F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits, else null; one conditional expression."""
    out = F
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = out.when(fits, F.lit(value(r)))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def strength(counts: DataFrame, *, least: float = 1.0, most: float = 1000.0) -> float:
    """The strength of the beta prior that a level's counts (n, bad) show, by moments about their pooled mean."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2")).first()
    if not total.n or total.k < 2 or not 0 < total.bad < total.n:
        return most
    m = total.bad / total.n
    spread = counts.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, F.lit(2)))).first()[0]
    # E[spread] = m(1-m) * ((k-1) + r * (N - n2/N - (k-1))), with r = 1 / (strength + 1)
    free = total.n - total.n2 / total.n - (total.k - 1)
    r = (spread / (m * (1 - m)) - (total.k - 1)) / free if free > 0 else 0.0
    return min(most, max(least, 1 / r - 1)) if r > 0 else most


def reputation(hosts: DataFrame, *, bound: float = 1.645) -> DataFrame:
    """hosts: host, domain, suffix, n, bad of every host. Adds the posterior's mean and lower bound (rate, low)."""
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = by_suffix.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    top = (bad + 0.5) / (n + 1) if n else 0.0
    s_suffix, s_domain, s_host = (strength(x.where("n > 0")) for x in (by_suffix, by_domain, hosts))

    def mean(prior: Column, s: float) -> Column:
        return (prior * s + F.col("bad")) / (s + F.col("n"))

    suffix = by_suffix.select("suffix", mean(F.lit(top), s_suffix).alias("above"))
    domain = by_domain.join(suffix, "suffix").select("domain", mean(F.col("above"), s_domain).alias("above"))
    rated = hosts.join(domain, "domain").withColumn("rate", mean(F.col("above"), s_host))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (s_host + F.col("n") + 1))
    return rated.select(*(c for c in hosts.columns if c not in ("domain", "suffix")), "rate", F.greatest(F.lit(0.0), F.col("rate") - bound * deviation).alias("low"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, *, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, limit: float = 0.5, bound: float = 1.645,
) -> DataFrame:
    """key, host, path, rule, verdict, n, bad, rate and low of every page. outcomes: key and bad (0 or 1) of labelled pages."""
    host, path = parts(F.col(named(url)))
    own = pages.select(F.col(named(key)).cast("long").alias("key"), host.alias("host"), path.alias("path"))
    marked = outcomes.select(F.col(outcomes.columns[0]).cast("long").alias("key"), F.col(outcomes.columns[1]).cast("int").alias("bad")).where("bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    counts = own.join(marked, "key", "left").groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = counts.select("host", registered_domain(F.col("host")).alias("domain"), "n_pages", "n", "bad")
    hosts = hosts.withColumn("suffix", F.when(F.col("domain").contains("."), F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(F.col("domain")))
    hosts = materialise(hosts, "hosts")  # each level reads the counts again
    rated = materialise(reputation(hosts, bound=bound), "rated")
    rule = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.name)
    ruled = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    learned = F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return spread_join(own, rated, "host", by="key", n="n_pages").select("key", "host", "path", rule.alias("rule"), F.coalesce(ruled, learned).alias("verdict"), "n", "bad", "rate", "low")


def _strength_sql(name: str, counts: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN big IS NULL OR k < 2 OR hits <= 0 OR hits >= big THEN 1000.0 WHEN r > 0 THEN least(1000.0, greatest(1.0, 1 / r - 1)) ELSE 1000.0 END AS s FROM (
  SELECT *, CASE WHEN big - n2 / big - (k - 1) > 0 THEN (spread / (hits / big * (1 - hits / big)) - (k - 1)) / (big - n2 / big - (k - 1)) ELSE 0 END AS r FROM (
    SELECT sum(n)::DOUBLE AS big, sum(bad)::DOUBLE AS hits, count(*)::DOUBLE AS k, sum(n::DOUBLE * n) AS n2, sum(n * pow(bad / n - (SELECT sum(bad) / sum(n) FROM {counts}), 2)) AS spread FROM {counts} WHERE n > 0)))"""


OP10_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marked AS (SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
named AS (SELECT host, string_split(host, '.') AS l, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM own LEFT JOIN marked ON doc_id = page_id GROUP BY ALL),
placed AS (SELECT *, array_to_string(CASE WHEN length(l[-1]) = 2 AND len(l) > 1 AND l[-2] IN ({', '.join(f"'{x}'" for x in SECOND)}) THEN l[-3:] ELSE l[-2:] END, '.') AS domain FROM named),
hosts AS (SELECT host, domain, CASE WHEN contains(domain, '.') THEN substr(domain, instr(domain, '.') + 1) ELSE domain END AS suffix, n, bad FROM placed),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
{_strength_sql("of_suffix", "suffixes")},
{_strength_sql("of_domain", "domains")},
{_strength_sql("of_host", "hosts")},
top AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0 END AS m FROM suffixes),
a AS (SELECT suffix, (m * s + bad) / (s + n) AS above FROM suffixes, top, of_suffix),
b AS (SELECT domain, (above * s + bad) / (s + n) AS above FROM domains JOIN a USING (suffix), of_domain),
rated AS (SELECT host, s, n, (above * s + bad) / (s + n) AS rate FROM hosts JOIN b USING (domain), of_host),
judged AS (SELECT own.*, rate, greatest(0.0, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (s + n + 1))) AS low FROM own JOIN rated USING (host)),
rules(r_host, r_path, r_verdict) AS (VALUES {', '.join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
ruled AS (SELECT page_id, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS said FROM judged JOIN rules
  ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS rate, round(low, 6) AS low FROM judged LEFT JOIN ruled USING (page_id)
"""


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. A labelled page, the one whose id a label carries, is bad if it is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcomes = labels.where("quality is not null or toxic is not null").select("doc_id", bad.alias("bad"))
    judged = judge_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("low", 6).alias("low"))
