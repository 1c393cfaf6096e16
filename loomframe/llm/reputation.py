"""Empirical-Bayes host reputation for URL filters, in SQL functions only.

Outcomes of labelled pages are counted by host. Beta-binomial priors go down from all pages to the public suffix, the
registered domain and the host: a node's prior has its parent's posterior mean, and a strength that the spread of all nodes
of its level about their parents' means gives (moments of the beta-binomial law). A host is blocked if the posterior
probability that its rate of bad pages is over ``cut`` is at least ``confidence``. That probability comes from numerical
integration of the beta density on the logit scale, by a double-exponential rule with the same nodes for every host.

Hosts are taken as written: after the first ``://``, A to Z in lower case. For the domain, a user name and a port are left
out. The registered domain is the public suffix and one label more; a host that is such a suffix, one label or an IP
address is its own domain.

Cases: a page without a URL or ``://`` has an empty host and path, counts for no host and is allowed, as are pages of hosts
without a label whose prior doesn't block them. A page with several labels is bad if one says so, and labels without a
value say nothing; pages that repeat are counted as often as they occur. Without any label all rates have a uniform law,
and no host is blocked. Ties in the length of fitting rules go to the rule listed first. An empty table gives an empty result.
Columns of pages other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Public suffixes of more than one label, the common ones. Others are the last label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: (action, host, path) of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is blocked if its rate of bad pages is over CUT with a posterior probability of CONFIDENCE.
CUT, CONFIDENCE = 0.3, 0.9
#: Least and largest share of a count's variance that the spread between nodes explains.
LEAST_SPREAD, LARGEST_SPREAD = 1e-4, 0.99
#: The share where no node has two labels: that of a uniform law.
UNKNOWN_SPREAD = 1 / 3
#: Nodes of the quadrature: the first value of the outer variable, its step and the number of steps.
NODES = (-4.5, 0.06, 200)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without a user name and a port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """struct<action, rule> of the longest rule that fits, or null: a fixed list, tested longest first."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, at, prefix in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(at + prefix).alias("rule"))).otherwise(found)
    return found


def _softplus(u: Column) -> Column:
    return F.when(u > 0, u + F.log1p(F.exp(-u))).otherwise(F.log1p(F.exp(u)))


def rate_over(a: Column, b: Column, cut: float) -> Column:
    """The probability that a Beta(a, b) rate is over the cut.

    With u the logit of the rate the density is exp(a u - (a + b) log(1 + e^u)), smooth and with one peak. Each side of the
    cut is integrated over v, with u = logit(cut) +- s exp(v - exp(-v)) and s the scale at the peak."""
    logit = math.log(cut / (1 - cut))
    begin, step, last = NODES
    nodes = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.lit(begin) + k * step)
    scale, mode = F.sqrt(1 / a + 1 / b), F.log(a / b)
    height = lambda u: a * u - (a + b) * _softplus(u)
    top = height(mode)
    reach = lambda v: F.exp(v - F.exp(-v))
    side = lambda sign: F.aggregate(nodes, F.lit(0.0), lambda s, v: s + reach(v) * (1 + F.exp(-v)) * F.exp(height(logit + sign * scale * reach(v)) - top))
    above, below = side(1), side(-1)
    return F.when(above + below > 0, above / (above + below)).otherwise((mode > logit).cast("double"))


def _spread(nodes: DataFrame) -> float:
    """The share of variance that differences between nodes add to their counts: rows of n, x and the parent's mean m. By
    moments: E (x - n m)^2 = n m (1 - m) (1 + (n - 1) spread)."""
    var = F.col("m") * (1 - F.col("m"))
    off = F.col("x") - F.col("n") * F.col("m")
    row = nodes.where("n > 0").agg(F.sum(off * off - F.col("n") * var).alias("more"), F.sum(F.col("n") * (F.col("n") - 1) * var).alias("most")).first()
    share = row["more"] / row["most"] if row["most"] else UNKNOWN_SPREAD
    return min(max(share, LEAST_SPREAD), LARGEST_SPREAD)


def _shrunk(nodes: DataFrame) -> DataFrame:
    """With the posterior Beta(a, b) of each node, from the strength of its level."""
    strength = 1 / _spread(nodes) - 1
    return nodes.withColumns({"a": F.col("m") * strength + F.col("x"), "b": (1 - F.col("m")) * strength + F.col("n") - F.col("x")})


def host_posteriors(counts: DataFrame, suffixes: Iterable[str] = SUFFIXES, cut: float = CUT) -> DataFrame:
    """host, n, x, a, b and p_bad of hosts with n labelled pages of which x are bad. Three numbers come to the driver for
    each level; a level's table joins the next one by the parent."""
    hosts = materialize(counts.where("host <> ''").select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "x"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    every = tops.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    overall = ((every["x"] or 0) + 0.5) / ((every["n"] or 0) + 1)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    tops = _shrunk(tops.withColumn("m", F.lit(overall))).select("suffix", mean.alias("m"))
    domains = materialize(_shrunk(domains.join(tops, "suffix")).select("domain", mean.alias("m")), "domains")
    return _shrunk(hosts.join(domains, "domain")).select("host", "n", "x", "a", "b").withColumn("p_bad", rate_over(F.col("a"), F.col("b"), cut))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, suffixes: Iterable[str] = SUFFIXES, cut: float = CUT, confidence: float = CONFIDENCE, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, n_labelled, n_bad and p_bad of every page. outcomes: id and a boolean, bad."""
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = parsed.select("id", "host").join(labels, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = host_posteriors(counts, suffixes, cut).select("host", "n", "x", "p_bad")
    # a host with a large share of the pages is a skewed key of a plain join, which Spark splits
    known = parsed.join(hosts, "host", "left").withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("p_bad") >= confidence, "block").otherwise("allow")
    return known.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", own).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_labelled"), F.coalesce("x", F.lit(0)).alias("n_bad"), "p_bad")
