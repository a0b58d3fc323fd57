"""URL filters: path rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  Beta-binomial priors
pass down the hierarchy suffix -> registered domain -> host: a level's prior
mean is its parent's posterior mean, its prior strength is estimated from how
much that level's rates differ (the ANOVA estimate of the intra-class
correlation).  A host is blocked when the lower bound of its beta posterior, the
``tail`` quantile of its bad rate, is above the limit, so few labels never block
a host on their own.  Suffixes come from a list of rules with wildcards and exceptions.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import BROADCAST_ROWS, LOWER, UPPER, stored
from tilespark.session import ship_by_value

#: The public list of suffixes as Linux systems install it; read on the driver only.
SUFFIX_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"
#: Public suffixes of two labels that are common on the web, for machines without a list.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
                      "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

#: The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))

#: Bounds of the estimated correlation, so that a prior is neither absent nor absolute.
RHO_LEAST, RHO_MOST = 0.001, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"^[\s\S]*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's string and action (null without one)."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def read_suffix_rules(path: str | None = SUFFIX_LIST) -> list[tuple[str, int, bool]]:
    """Rules (name, labels of the suffix, exception?) of a public suffix list; without one, of ``TWO_LABEL_SUFFIXES``.

    ``*.x`` makes every name below ``x`` a suffix, ``!a.x`` takes one back; names that
    are not ASCII are met in both spellings."""
    lines = TWO_LABEL_SUFFIXES
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            lines = [x.split()[0] for x in f if x.strip() and not x.startswith("//")]
    rules = set()
    for line in lines:
        name = line.lower().removeprefix("!").removeprefix("*.")
        width = name.count(".") + 1 + line.startswith("*.") - line.startswith("!")
        rules |= {(x, width, line.startswith("!")) for x in (name, name.encode("idna").decode())}
    return sorted(rules)


def with_domains(hosts: DataFrame, rules: Sequence[tuple[str, int, bool]]) -> DataFrame:
    """``hosts`` (distinct ``host`` and other columns) with public ``suffix`` and registered ``domain`` (the host
    itself where it has no label above the suffix).

    An exception wins, then the longest rule; without any the last label is the suffix.  The names a host could
    match are looked up in the rules, which are broadcast if they are no more than ``BROADCAST_ROWS``."""
    known = hosts.sparkSession.createDataFrame(list(rules) or [("", 1, False)], "__name string, __width int, __except boolean")
    known = F.broadcast(known) if len(rules) <= BROADCAST_ROWS else known
    labels = F.split("host", r"\.")
    most = max((r[0].count(".") + 1 for r in rules), default=1)
    names = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
                        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    met = hosts.withColumn("__name", F.explode(names)).join(known, "__name", "left")
    fits = F.when(F.col("__width") <= F.size(labels), F.struct("__except", "__width"))
    found = met.groupBy(*hosts.columns).agg(F.coalesce(F.max(fits)["__width"], F.lit(1)).alias("__width"))

    def last(width: Column) -> Column:
        width = F.least(width, F.size(labels))
        return F.array_join(F.slice(labels, F.size(labels) - width + 1, width), ".")

    return found.withColumns({"suffix": last(F.col("__width")), "domain": last(F.col("__width") + 1)}).drop("__width")


def beta_below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """P(rate <= x) of Beta(a, b): the series in rising powers of x, taken from the side where its terms fall."""
    turned = x > a / (a + b)
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    x = np.where(turned, 1 - x, x)
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((gamma(a + b) - gamma(a + 1) - gamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x))
    total, term, n = np.ones(len(a)), np.ones(len(a)), 0
    on = np.arange(len(a))
    while len(on):
        term[on] *= (a[on] + b[on] + n) / (a[on] + 1 + n) * x[on]
        total[on] += term[on]
        n += 1
        on = on[term[on] > 1e-17 * total[on]]
    got = front * total
    return np.where(turned, 1 - got, got)


def prior_strength(groups: DataFrame, parent: str) -> float:
    """Pseudo-count of a level's prior from its groups' ``n`` and ``bad``: 1/rho - 1,
    rho being the intra-class correlation of ``groups`` within ``parent``.  One row reaches the driver."""
    g = groups.where("n > 0")
    up = (g.groupBy(parent).agg(F.sum("n").alias("m"), F.sum("bad").alias("x"), F.count(F.lit(1)).alias("k"),
                                F.sum(F.col("n") * F.col("n")).alias("nn"),
                                F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("xx")))
    r = up.agg(F.sum(F.col("xx") - F.col("x") * F.col("x") / F.col("m")).alias("between"),
               F.sum(F.col("x") - F.col("xx")).alias("within"),
               F.sum(F.col("k") - 1).alias("df_between"), F.sum(F.col("m") - F.col("k")).alias("df_within"),
               F.sum(F.col("m") - F.col("nn") / F.col("m")).alias("spread")).first()
    if not r["df_between"] or not r["df_within"]:
        return 1 / RHO_LEAST - 1 if not r["df_between"] else 1 / RHO_MOST - 1
    msb, msw = r["between"] / r["df_between"], r["within"] / r["df_within"]
    n0 = r["spread"] / r["df_between"]
    below = msb + (n0 - 1) * msw
    rho = (msb - msw) / below if below > 0 else RHO_LEAST
    return 1 / min(RHO_MOST, max(RHO_LEAST, rho)) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, limit: float = 0.5,
                    suffix_rules: Sequence[tuple[str, int, bool]] | None = None) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): n, bad, ``mean`` and ``below``, the posterior
    probability that its bad rate is at most ``limit``.

    ``outcomes`` is (page_id, bad 0/1/null).  Pages without an outcome count in
    no total; a host without labels has its domain's posterior as prior.
    """
    ship_by_value("tilespark.llm.url_filter")
    seen = pages.join(outcomes, "page_id", "left")
    counts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(with_domains(counts, read_suffix_rules() if suffix_rules is None else suffix_rules).withColumn("all", F.lit(0)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix", "all").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_suffix = prior_strength(suffixes, "all")
    k_domain = prior_strength(domains, "suffix")
    k_host = prior_strength(hosts, "domain")
    t = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((t["bad"] or 0) + 0.5) / ((t["n"] or 0) + 1.0)

    def shrunk(k: float, mean: Column) -> Column:
        return (F.col("bad") + F.lit(k) * mean) / (F.col("n") + F.lit(k))

    s = suffixes.select("suffix", shrunk(k_suffix, F.lit(top)).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(k_domain, F.col("suffix_mean")).alias("domain_mean"))
    rows = hosts.join(d, ["domain", "suffix"]).select("host", "n", F.col("bad").cast("long").alias("bad"),
                                                      shrunk(k_host, F.col("domain_mean")).alias("mean"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, mean = b.column(1).to_numpy() + k_host, b.column(3).to_numpy()
            below = beta_below(n * mean, n * (1 - mean), limit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(below, pa.float64())], ["host", "n", "bad", "mean", "below"])

    return rows.mapInArrow(bounded, "host string, n long, bad long, mean double, below double")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5,
               tail: float = 0.05, suffix_rules: Sequence[tuple[str, int, bool]] | None = None) -> DataFrame:
    """One row per page: page_id, host, path, ``rule``, ``verdict``; other columns are dropped.

    The longest rule that fits decides (both a rule's host and its subdomains,
    path by its beginning); other pages are blocked when the lower bound of their
    host's bad rate, the posterior's ``tail`` quantile, is above ``limit``: the rate is
    at most ``limit`` with a probability under ``tail``.  ``suffix_rules`` are those of
    ``read_suffix_rules``, by default of ``SUFFIX_LIST``.  Null or unusual urls
    have an empty host, which is a host like any other.  Repeated page ids give
    a row each; null ids have no label.  An empty table gives no rows.  The
    host side of the last join is one row per host; pages of a hot host are
    split by the adaptive skew join.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    one = (outcomes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad")))
    rep = host_reputation(rows.select("page_id", "host"), one, limit, suffix_rules)
    rule, action = rule_column(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("below") < tail, F.lit("block")).otherwise(F.lit("allow"))
    return (rows.join(rep.select("host", "below"), "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict")))
