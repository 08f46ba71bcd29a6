"""URL filter by empirical-Bayes host reputation (operator 10), DataFrame functions only.

Labelled page outcomes (``labels.doc_id`` names the page; an outcome is good
where quality is 1 and toxic is not 1) are counted per host.  The share of good
pages is shrunk level by level through beta-binomial priors: the suffix towards
the share over all outcomes, the registered domain towards its suffix, the host
towards its domain.  The prior strength of each level is estimated from the
outcomes by moments,

    strength = m (1 - m) / max(between-group variance, 1e-6) - 1, within [1, 200],

with the variance between the groups weighted by outcomes and freed of the
binomial part.  A url is blocked where the posterior bound
``mean + 1.645 sd`` of its host is under ``MIN_GOOD``: only hosts that are bad
with confidence go.  Explicit rules (host suffix, path prefix) come first; of the
rules that fit, the longest wins (of equal ones, block).

For its reputation a host counts without user name and port.  The suffix is the
last label, or the last two where they are one of ``SECOND_LEVEL``; the domain is
the suffix and the label before it.  Numeric addresses are whole: such a host is
its own domain, and all of them share the suffix ``(address)``.

Hosts and domains are aggregated once and kept as tables; the share over all
outcomes (one row) and the strengths (one pass over the three levels, three rows)
come to the driver as numbers.

Defined cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is judged by the prior over all outcomes; so is an empty host, and
outcomes of such pages count in that share only; unlabelled hosts take their
domain's or suffix's prior; labels with null outcome are not counted; repeated
rows each count and each give a row; other columns are ignored; empty tables are
accepted (without outcomes the share is 0.5).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stash, table

MIN_GOOD = 0.6
Z = 1.645
# Second-level names under which domains are registered.
SECOND_LEVEL = tuple(
    "ac.jp ac.uk ac.za co.at co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.pl com.sa com.sg com.tr com.tw com.ua com.ve com.vn edu.au edu.cn edu.mx gob.es gob.mx gouv.fr gov.au gov.br gov.cn gov.in gov.uk ne.jp net.au net.br net.cn or.at or.jp or.kr org.au org.br org.cn org.mx org.uk".split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_PORT = r"^(.*?):[0-9]*$"
_ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _SPLIT, 1), UPPER, LOWER), F.regexp_extract(url, _SPLIT, 2)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _name(host: Column) -> Column:
    """The host without user name and port."""
    bare = F.regexp_replace(host, "^.*@", "")
    return F.regexp_replace(bare, _PORT, "$1")


def _suffix(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), F.lit("(address)")).when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def _domain(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def _moments(level: DataFrame, name: str, m: float) -> DataFrame:
    n, s = F.col("n"), F.col("s")
    return level.filter("n > 0").select(F.lit(name).alias("level"), n, (n * n).alias("nn"), (n * F.pow(s / n - m, 2.0)).alias("dev"))


def _strength(t: float | None, q: float | None, v: float | None, k: int, m: float) -> float:
    """Prior strength of a level of ``k`` groups: sums of n, of n * n and of weighted squared deviations."""
    if not t:
        return 200.0
    between = (v - m * (1.0 - m) * (k - 1)) / max(t - q / t, 1e-9)
    return min(max(m * (1.0 - m) / max(between, 1e-6) - 1.0, 1.0), 200.0)


def reputation(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(name, n, s, mean, bound) of the posterior of every host that has a name, and the bound of the prior over all."""
    host, _ = host_and_path(F.col("url"))
    good = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").select(
        F.col("doc_id").alias("page_id"),
        ((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("long").alias("good"),
    )
    seen = pages.select("page_id", _name(host).alias("name")).join(good, "page_id", "left")
    counted = seen.groupBy("name").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("s"))
    every = stash(counted.withColumn("domain", _domain(F.col("name"))).withColumn("suffix", _suffix(F.col("name"))), "hosts")
    hosts = every.filter("name <> ''")
    domains = stash(hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.first("suffix").alias("suffix")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = every.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    m = total.s / total.n if total.n else 0.5
    levels = _moments(suffixes, "s", m).unionByName(_moments(domains, "d", m)).unionByName(_moments(hosts, "h", m))
    sums = {r.level: r for r in levels.groupBy("level").agg(F.sum("n").alias("t"), F.sum("nn").alias("q"), F.sum("dev").alias("v"), F.count(F.lit(1)).alias("k")).collect()}  # three rows
    ks, kd, kh = (_strength(sums[x].t, sums[x].q, sums[x].v, sums[x].k, m) if x in sums else 200.0 for x in "sdh")
    up = suffixes.select("suffix", ((F.col("s") + ks * m) / (F.col("n") + ks)).alias("ms"))
    mid = domains.join(up, "suffix").select("domain", ((F.col("s") + kd * F.col("ms")) / (F.col("n") + kd)).alias("md"))
    a, b = F.col("s") + kh * F.col("md"), F.col("n") - F.col("s") + kh * (1.0 - F.col("md"))
    mean = a / (a + b)
    known = hosts.join(mid, "domain").select(
        "name", F.col("n").cast("long").alias("n"), F.col("s").cast("long").alias("s"), mean.alias("mean"), (mean + Z * F.sqrt(mean * (1.0 - mean) / (a + b + 1.0))).alias("bound")
    )
    return known, m + Z * math.sqrt(m * (1.0 - m) / (kh + 1.0))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    labels = labels.select("doc_id", "quality", "toxic")
    known, any_bound = reputation(pages, labels)
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("name", _name(F.col("host")))
    df = df.join(known.select("name", (F.round("bound", 9) < min_good).alias("bad")), "name", "left")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("bad", F.lit(round(any_bound, 9) < min_good)), F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _rule_sql(what: str) -> str:
    ordered = sorted(RULES, key=lambda r: (len(r.name), r.verdict == "block"), reverse=True)
    cases = " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name if what == 'rule' else r.verdict}'" for r in ordered)
    return f"case {cases} end"


def _prior_sql(level: str, name: str) -> str:
    return f"""{name} as (
      select coalesce(least(greatest(m * (1.0 - m) / greatest((v - m * (1.0 - m) * (k - 1)) / greatest(t - q / t, 1e-9), 1e-6) - 1.0, 1.0), 200.0), 200.0) as {name}
      from (select sum(n) as t, sum(n * n) as q, sum(n * pow(s / n - m, 2)) as v, count(*) as k, max(m) as m from {level}, whole where n > 0)
    )"""


_SECOND = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
SQL = f"""
with cut as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '{_SPLIT}', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '{_SPLIT}', 2) as path
  from pages
), outcomes as (
  select doc_id as page_id, case when coalesce(quality, 1) = 1 and coalesce(toxic, 0) <> 1 then 1 else 0 end as good
  from labels where quality is not null or toxic is not null
), named as (
  select *, regexp_replace(regexp_replace(host, '^.*@', ''), '{_PORT}', '\\1') as name from cut
), counted as (
  select name, cast(count(good) as double) as n, cast(coalesce(sum(good), 0) as double) as s,
         string_split(name, '.') as parts, regexp_matches(name, '{_ADDRESS}') as address
  from named left join outcomes using (page_id) group by name
), split as (
  select *, array_to_string(parts[-2:], '.') as two from counted
), hosts as (
  select name, n, s,
         case when address then name when two in ({_SECOND}) then array_to_string(parts[-3:], '.') else two end as domain,
         case when address then '(address)' when two in ({_SECOND}) then two else parts[-1] end as suffix
  from split where name <> ''
), domains as (select domain, sum(n) as n, sum(s) as s, min(suffix) as suffix from hosts group by domain),
suffixes as (select suffix, sum(n) as n, sum(s) as s from domains group by suffix),
whole as (select coalesce(sum(s) / nullif(sum(n), 0), 0.5) as m from counted),
{_prior_sql('suffixes', 'ks')}, {_prior_sql('domains', 'kd')}, {_prior_sql('hosts', 'kh')},
up as (select suffix, (s + ks * m) / (n + ks) as ms from suffixes, ks, whole),
mid as (select domain, (s + kd * ms) / (n + kd) as md from domains join up using (suffix), kd),
post as (
  select name, (s + kh * md) / (n + kh) as mean, n + kh as size from hosts join mid using (domain), kh
), known as (
  select name, round(mean + {Z} * sqrt(mean * (1.0 - mean) / (size + 1.0)), 9) < {MIN_GOOD} as bad from post
), every as (
  select round(m + {Z} * sqrt(m * (1.0 - m) / (kh + 1.0)), 9) < {MIN_GOOD} as any_bad from whole, kh
)
select page_id, host, path, {_rule_sql('rule')} as rule,
       coalesce({_rule_sql('verdict')}, case when coalesce(bad, any_bad) then 'block' else 'allow' end) as verdict
from named left join known using (name), every
"""
