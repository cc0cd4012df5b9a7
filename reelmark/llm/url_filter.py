"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. Each level of the name hierarchy, suffix, registered domain and
host, has a beta-binomial prior whose mean is the level above and whose strength follows from how much the
level's rates differ beyond chance. A host is blocked when the lower bound of its posterior rate of bad pages
is above a limit, so hosts with little evidence follow their domain and are not blocked by a few pages.
Explicit rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import settle
from .texts import UPPER

# Second labels under which names are registered where the last label is a country's.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LIMIT = 0.5
Z = 1.645  # one-sided 95 %


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffix(host: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(host, ":[0-9]*$", ""), "[.]"), -1)


def host_domain(host: Column) -> Column:
    """The registered domain: the last two labels, or three below a country's second level."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), "[.]")
    third = (F.char_length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    wanted = F.when(third, 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(wanted, F.size(labels)), F.least(wanted, F.size(labels))), ".")


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level from the intraclass correlation of its groups (columns ``n``, ``bad``)."""
    s = groups.filter("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("b"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"),
    ).first()
    if not s.k or s.k < 2 or s.n <= s.k:
        return 1 / 0.1 - 1
    between = (s.bb - s.b * s.b / s.n) / (s.k - 1)
    within = (s.b - s.bb) / (s.n - s.k)
    size = (s.n - s.nn / s.n) / (s.k - 1)
    spread = between + (size - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return 1 / min(0.5, max(1e-3, rho)) - 1


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """One row for each host: ``host, n, bad, rate, bound`` from rows of ``host, bad`` (null: not labelled).

    Levels are sums of the level below, so only the first count reads outcomes. Of each level the driver
    sees one row of five sums.
    """
    hosts = settle(
        outcomes.groupBy("host").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
        ).withColumns({"domain": host_domain(F.col("host")), "suffix": host_suffix(F.col("host"))})
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((total.bad or 0) + 1) / ((total.n or 0) + 2)
    m_suffix, m_domain, m_host = _strength(suffixes), _strength(domains), _strength(hosts)
    shrunk = lambda prior, m: (F.col("bad") + F.lit(m) * prior) / (F.col("n") + F.lit(m))
    by_suffix = suffixes.select("suffix", shrunk(F.lit(mean), m_suffix).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), m_domain).alias("domain_rate"))
    posterior = hosts.join(by_domain, ["domain", "suffix"]).withColumn("rate", shrunk(F.col("domain_rate"), m_host))
    width = F.lit(Z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(m_host) + 1))
    return posterior.select("host", "n", "bad", "rate", (F.col("rate") - width).alias("bound"))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, or null. The rules are a configuration and become one expression."""
    fit = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        on_host = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        fit = F.when(on_host & F.startswith(path, F.lit(r.path)), F.lit(r.name)).otherwise(fit)
    return fit


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """All rows of ``pages`` as ``page``, with ``host, path, rule, bound, verdict``.

    ``outcomes`` has ``url`` and ``bad``. A null url, or one without a scheme, has an empty host and path;
    such pages share the reputation of the empty host. Rows are judged one by one, repeated ones alike, and an
    empty table gives none. The host table has one row for each host; a host with very many pages is split by
    Spark's skew handling where the table is too large to send around.
    """
    rep = host_reputation(outcomes.select(url_host(F.col("url")).alias("host"), "bad"))
    rep = rep.select(F.col("host").alias("r_host"), "bound")
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"),
        url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
    ).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(by_rule)
    by_host = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.join(rep, F.col("host") == F.col("r_host"), "left").drop("r_host")
    return joined.withColumn("verdict", F.coalesce(by_rule, by_host))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad``: the document a page shows is numbered in its path; its labels say whether the page is bad."""
    number = F.regexp_extract(url_path(F.col("url")), "/([0-9]{1,18})(?:[.]html|/)?$", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("doc_number"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return shown.join(marks, F.col("doc_number") == F.col("doc_id"), "left").select("url", "bad")


def _sql_strength(source: str) -> str:
    return f"""(select case when k < 2 or n <= k then 9.0 else 1 / least(0.5, greatest(1e-3,
      case when (bb - b * b / n) / (k - 1) + ((n - nn / n) / (k - 1) - 1) * (b - bb) / (n - k) > 0
        then ((bb - b * b / n) / (k - 1) - (b - bb) / (n - k)) / ((bb - b * b / n) / (k - 1) + ((n - nn / n) / (k - 1) - 1) * (b - bb) / (n - k))
        else 0 end)) - 1 end
      from (select count(*)::double as k, sum(n)::double as n, sum(bad)::double as b, sum(n * n)::double as nn, sum(bad * bad / n::double) as bb
            from {source} where n > 0) t)"""


ORACLE = f"""
with cut as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
marks as (select doc_id, bool_or(quality = 0 or toxic = 1) as bad from labels group by doc_id),
outcome as (
  select host, bad from p left join marks on try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[.]html|/)?$', 1), '') as bigint) = doc_id),
hosts as (
  select host, count(bad) as n, count(*) filter (where bad) as bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as l from outcome group by host),
named as (
  select host, n, bad, l[-1] as suffix,
         array_to_string(l[greatest(1, len(l) - case when length(l[-1]) = 2 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end):], '.') as domain
  from hosts),
domains as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from named group by domain, suffix),
suffixes as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by suffix),
s as (
  select {_sql_strength("suffixes")} as ms, {_sql_strength("domains")} as md, {_sql_strength("named")} as mh,
         (select (sum(bad) + 1) / (sum(n) + 2.0::double) from suffixes) as mean),
sr as (select suffix, (bad + ms * mean) / (n + ms) as r from suffixes, s),
dr as (select domain, d.suffix, (bad + md * sr.r) / (n + md) as r from domains d join sr on d.suffix = sr.suffix, s),
hr as (select host, n, (n0.bad + mh * dr.r) / (n + mh) as rate, mh from named n0 join dr on n0.domain = dr.domain and n0.suffix = dr.suffix, s),
bound as (select host, rate - {Z} * sqrt(rate * (1 - rate) / (n + mh + 1)) as bound from hr),
ruled as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from p)
select page_id, r.host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when bound > {LIMIT} then 'block' else 'allow' end as verdict
from ruled r left join bound b on r.host = b.host
"""


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, labelled_pages(pages, labels)).select("page.page_id", "host", "path", "rule", "verdict")
