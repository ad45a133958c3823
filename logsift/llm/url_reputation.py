"""URL filter: host rules first, then the host's reputation by empirical Bayes.

Labelled outcomes of pages (good or not) are counted per host. A host's rate of good pages is shrunk towards that of its
registered domain, this towards that of its public suffix, and this towards the rate of all. How strongly comes from the
data: at each level the analysis of variance of the rates gives the correlation rho of outcomes within a unit, and a prior
worth 1 / rho - 1 outcomes. A host passes if the lower bound of its beta posterior (mean less z standard deviations) reaches
`min_good`. Hosts without outcomes are judged by their domain and suffix; where no page at all is labelled, all pass.

Only DataFrame functions. Outcomes are summed before the shuffle, the verdicts come back by a join on the host that Spark
can split, so a host with a third of all pages is no large task. The driver reads one row of totals.

A null URL, or one without ://, has an empty host and path and is judged as the host ''. Rows repeat as they do in the input.
Rows of `outcomes` with a null host or outcome count for nothing. New columns replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of more than one label; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")


@dataclass(frozen=True)
class Reputation:
    min_good: float = 0.65
    z: float = 1.645
    weakest: float = 1.0
    strongest: float = 1000.0
    unknown: float = 20.0  # outcomes a prior is worth where its level has nothing to tell from


def url_host(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: str | Column) -> Column:
    """After the host up to ?, # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _last(suffixes: tuple[str, ...]) -> str:
    return "(" + "|".join([*(s.replace(".", r"\.") for s in suffixes), "[^.]+"]) + ")$"


def url_suffix(host: str | Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    host = _bare(F.col(host) if isinstance(host, str) else host)
    return F.when(host.rlike(r"^[0-9.]+$|^\["), F.lit("ip")).otherwise(F.regexp_extract(host, r"(?:^|\.)" + _last(suffixes), 1))


def url_domain(host: str | Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and one label more."""
    host = _bare(F.col(host) if isinstance(host, str) else host)
    return F.when(host.rlike(r"^[0-9.]+$|^\["), host).otherwise(F.regexp_extract(host, r"(?:[^.]+\.)?" + _last(suffixes), 0))


def rule_for(host: str, path: str, rules: list[tuple[str, str]]) -> Column:
    """The longest (action, rule) that fits, as a struct of both, or null. A rule is a host and a path: it fits the host and
    its subdomains where the path starts with the rule's. Of equal rules, block wins. Rules are a short list."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def host_reputation(outcomes: DataFrame, host: str = "host", good: str = "good", settings: Reputation = Reputation(),
                    suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, labelled, good, bound, verdict) for every host in `outcomes`; a null outcome is not labelled.
    `suffixes` are the public suffixes of more than one label."""
    counts = outcomes.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.col(good)).alias("n"), F.coalesce(F.sum(F.col(good).cast("long")), F.lit(0)).alias("k"))
    hosts = stored(counts.select("host", url_domain("host", suffixes).alias("domain"), url_suffix("host", suffixes).alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    ends = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    every = ends.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("an"), F.coalesce(F.sum("sk"), F.lit(0)).alias("ak")).first()
    mean = (every.ak + 1) / (every.an + 2)
    host_worth = _worth(hosts.join(domains, ["domain", "suffix"]), "n", "k", "dn", "dk", ["domain", "suffix"], settings)
    domain_worth = _worth(domains.join(ends, "suffix"), "dn", "dk", "sn", "sk", ["suffix"], settings)
    suffix_worth = _worth(ends.withColumns({"an": F.lit(every.an), "ak": F.lit(every.ak)}), "sn", "sk", "an", "ak", ["an"], settings)

    ends = ends.withColumn("sm", (F.col("sk") + suffix_worth * mean) / (F.col("sn") + suffix_worth))
    domains = domains.join(ends, "suffix").withColumn("dm", (F.col("dk") + domain_worth * F.col("sm")) / (F.col("dn") + domain_worth))
    judged = hosts.join(domains.select("domain", "suffix", "dm"), ["domain", "suffix"])
    total = F.col("n") + host_worth
    rate = (F.col("k") + host_worth * F.col("dm")) / total
    bound = rate - settings.z * F.sqrt(rate * (1 - rate) / (total + 1))
    passes = (bound >= settings.min_good) | F.lit(every.an == 0)
    return judged.select("host", "domain", "suffix", F.col("n").alias("labelled"), F.col("k").alias("good"), bound.alias("bound"),
                         F.when(passes, "allow").otherwise("block").alias("verdict"))


def _worth(units: DataFrame, n: str, k: str, pn: str, pk: str, parent: list[str], settings: Reputation) -> float:
    """The outcomes a unit's prior is worth: 1 / rho - 1, rho from the mean squares between units of a parent and within units."""
    n, k, pn, pk = (F.col(c).cast("double") for c in (n, k, pn, pk))
    x = units.where(n > 0).agg(
        F.count("*").alias("g"), F.count_distinct(*parent).alias("p"), F.sum(n).alias("n"), F.sum(n * (F.try_divide(k, n) - F.try_divide(pk, pn)) ** 2).alias("between"),
        F.sum(k * (1 - F.try_divide(k, n))).alias("within"), F.sum(F.try_divide(n * n, pn)).alias("squares")).first()
    if x.g <= x.p or x.n <= x.g:
        return settings.unknown
    between, within, typical = x.between / (x.g - x.p), x.within / (x.n - x.g), (x.n - x.squares) / (x.g - x.p)
    below = between + (typical - 1) * within
    rho = (between - within) / below if below > 0 else 0.0
    return 1 / min(max(rho, 1 / (1 + settings.strongest)), 1 / (1 + settings.weakest)) - 1


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url: str = "url", settings: Reputation = Reputation(),
                suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The pages with host, path, rule, verdict, labelled and good. `outcomes` has url and good, null where a page is not
    labelled; it should have all pages, since hosts that it lacks are judged by nothing and pass."""
    known = host_reputation(outcomes.select(url_host(url).alias("host"), "good"), settings=settings, suffixes=suffixes)
    known = known.select(F.col("host").alias("__host"), F.col("verdict").alias("__verdict"), F.col("labelled").alias("__n"), F.col("good").alias("__k"))
    parts = pages.withColumns({"host": url_host(url), "path": url_path(url)}).withColumn("__rule", rule_for("host", "path", rules))
    out = parts.join(known, parts["host"] == known["__host"], "left")
    return out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.action", "__verdict", F.lit("allow")),
                            "labelled": F.coalesce("__n", F.lit(0)), "good": F.coalesce("__k", F.lit(0))}).drop("__rule", "__host", "__verdict", "__n", "__k")
