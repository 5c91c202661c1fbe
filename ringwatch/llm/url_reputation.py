"""Judge urls by rules and, where no rule fits, by the reputation of their host.

Labelled page outcomes are counted per host and shrunk with beta-binomial priors: the rate of a
suffix towards the overall rate, a registered domain towards its suffix, a host towards its
domain. Each level's prior strength comes from the data by moments. A host is blocked when the
lower bound of its posterior bad rate passes a limit, so little evidence never blocks.

Edge cases: a null url or one without `://` has an empty host and path and is judged as the host
"". Pages without a label count for nothing but get a verdict. Without any label every host has
the flat prior. Repeated page ids give repeated rows; repeated labels of a page count once, bad
if any is bad. Columns of other names in the input are not read.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import with_missing
from ringwatch.session import cut_lineage

#: (rule, verdict): host, then path
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: suffixes of two labels under which names are registered
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
BLOCK_ABOVE = 0.5
Z = 1.64


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def prior_strength(groups: DataFrame) -> float:
    """The strength (alpha + beta) of the beta prior over groups with `n` outcomes, `bad` of them bad.

    Moment estimate of the intra-group correlation, kept between 0.001 and 0.9.
    """
    t = groups.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count(F.lit(1)).alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("b2"),
    ).first()
    if not t["n"] or t["g"] < 2:
        return 1.0
    p = t["bad"] / t["n"]
    room = p * (1 - p) * (t["n"] - t["n2"] / t["n"] - (t["g"] - 1))
    if room <= 0:
        return 1.0
    rho = (t["b2"] - t["n"] * p * p - (t["g"] - 1) * p * (1 - p)) / room
    rho = min(max(rho, 0.001), 0.9)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, bad_rate, bad_sd) from rows (host, bad), bad null where the page has no label."""
    hosts = cut_lineage(
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    k_suffix, k_domain, k_host = (prior_strength(g) for g in (suffixes, domains, hosts))
    rate = lambda k, mean: (F.col("bad") + k * mean) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", rate(k_suffix, F.lit(overall)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", rate(k_domain, F.col("suffix_rate")).alias("domain_rate"))
    a = F.col("bad") + k_host * F.col("domain_rate")
    b = F.col("n") - F.col("bad") + k_host * (1 - F.col("domain_rate"))
    return hosts.join(domains, ["domain", "suffix"]).select(
        "host", "n", "bad", (a / (a + b)).alias("bad_rate"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("bad_sd")
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, block_above: float = BLOCK_ABOVE, z: float = Z
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_bound.

    `outcomes` has page_id and bad (0 or 1). bad_bound is the posterior mean less z standard
    deviations; it decides where no rule fits.
    """
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    url = F.col("url")
    split = with_missing(pages, page_id="long", url="string").select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path")
    )
    # written, so that the last join shuffles both its sides itself and can split a hot host
    reputation = cut_lineage(host_reputation(split.join(labels, "page_id", "left").select("host", "bad")))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    bound = F.col("bad_rate") - z * F.col("bad_sd")
    method = F.when(bound > block_above, "block").otherwise("allow")
    return split.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), bound.alias("bad_bound")
    )
