"""URL filter: explicit rules, then empirical-Bayes reputation of hosts.

Outcomes are labelled pages: 1 (bad) or 0, each by its own url and content. A host's share of bad pages is shrunk by a beta
prior around its registered domain's, that around its suffix's, that around the overall one. Prior strengths come from the
data by the method of moments. A host is blocked when its beta posterior has at least ``SURE`` of its mass above ``LIMIT``,
which is to say that the posterior's lower bound at that level is above it.

A suffix is the last label, or the last two where a country code follows one of ``SECOND``; a registered domain is a suffix
and the label before it.

All of it is DataFrame operations. Counts are combined before they are shuffled; the join back to the pages is a plain
equi-join on the host, which adaptive execution broadcasts when the measured side is small and splits where a host is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ascii_lower, keep

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a page's url or content that label the page as bad.
BAD_TERMS = ("spam", "pills", "casino", "bets", "porn", "viagra", "warez")
#: Labels before a country code that make a suffix with it.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
_SUFFIX = rf"((?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]*)$"
#: ``STEPS`` points on each side of the posterior's centre, as far as ``REACH`` standard deviations of the log odds.
SURE, LIMIT, WEAKEST, STRONGEST, STEPS, REACH = 0.95, 0.5, 1.0, 1000.0, 200, 8.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without a scheme or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest(rules, host: Column, path: Column, value) -> Column:
    """The value of the longest rule that fits (ties: first in code-point order), else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), tuple(-ord(c) for c in r[1] + r[2]))):
        fits = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    """A suffix and the label before it (a host of one label, or an IPv4 address, whole)."""
    found = F.regexp_extract(host, r"(^|\.)([^.]*\." + _SUFFIX[:-1] + ")$", 2)
    return F.when(F.regexp_like(host, F.lit(r"^[0-9.]*$")) | (found == ""), host).otherwise(found)


def suffix_of(host: Column) -> Column:
    return F.when(F.regexp_like(host, F.lit(r"^[0-9.]*$")), F.lit("")).otherwise(F.regexp_extract(host, r"(^|\.)" + _SUFFIX, 2))


def _strength(groups: DataFrame, n: str, bad: str) -> float:
    """A prior's strength by the method of moments: spread of the groups' rates beyond what binomial draws give.

    One row of sums reaches the driver."""
    sums = F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.count("*").alias("k"), F.round(F.sum(F.col(bad) * F.col(bad) / F.col(n)), 6).alias("sq")
    x = groups.agg(*sums).first()
    if not x.k or x.k >= x.n or x.bad in (0, x.n):
        return STRONGEST
    mean = x.bad / x.n
    noise = mean * (1 - mean)
    share = (x.sq / x.n - mean * mean - noise * x.k / x.n) / (noise * (1 - x.k / x.n))
    return STRONGEST if share <= 1 / (1 + STRONGEST) else round(max(WEAKEST, 1 / share - 1), 6)


def mass_above(a: Column, b: Column, limit: float = LIMIT) -> Column:
    """How much of the beta distribution (a, b) lies above ``limit``: its density over the log odds, summed on a grid about
    the centre. Stable for any a and b above 0."""
    centre, step = F.ln(a / b), F.sqrt(1 / a + 1 / b) * (REACH / STEPS)
    edge = math.log(limit / (1 - limit))

    def log_density(x: Column, t: Column) -> Column:
        return x["a"] * t - (x["a"] + x["b"]) * (F.greatest(t, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(t))))

    def add(x: Column):
        def more(s: Column, i: Column) -> Column:
            t = x["c"] + x["s"] * i
            f = F.exp(log_density(x, t) - x["top"])
            return F.struct((s["all"] + f).alias("all"), (s["above"] + f * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - edge) / x["s"] + 0.5))).alias("above"))

        return F.aggregate(F.sequence(F.lit(-STEPS), F.lit(STEPS)), F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("above")), more, lambda s: s["above"] / s["all"])

    one = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), centre.alias("c"), step.alias("s"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), x["s"].alias("s"), log_density(x, x["c"]).alias("top")))
    return F.get(F.transform(one, add), F.lit(0))


def reputation(outcomes: DataFrame) -> DataFrame:
    """From ``outcomes(host, bad)`` to host, n, bad, mean, above (the posterior's mass above ``LIMIT``), blocked; null ``bad`` is no label."""
    host = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    host = host.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    host = keep(host)
    dom = host.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    suf = dom.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    every = suf.agg(F.sum("sn").alias("en"), F.sum("sbad").alias("ebad")).first()
    s0, s1, s2 = (_strength(*x) for x in ((suf, "sn", "sbad"), (dom, "dn", "dbad"), (host, "n", "bad")))
    out = host.join(dom, ["domain", "suffix"]).join(suf, "suffix")
    m0 = ((every.ebad or 0.0) + 1) / ((every.en or 0.0) + 2)
    m1 = (F.lit(s0 * m0) + F.col("sbad")) / (F.col("sn") + s0)
    m2 = (m1 * s1 + F.col("dbad")) / (F.col("dn") + s1)
    out = out.withColumn("total", F.col("n") + s2).withColumn("mean", (m2 * s2 + F.col("bad")) / F.col("total"))
    above = F.round(mass_above(F.col("mean") * F.col("total"), (1 - F.col("mean")) * F.col("total")), 6)
    return out.select("host", "n", "bad", "mean", above.alias("above")).withColumn("blocked", F.col("above") >= SURE)


def judge_urls(pages: DataFrame, rules=RULES, bad_terms=BAD_TERMS, labels: DataFrame | None = None) -> DataFrame:
    """Return page_id, host, path, rule, verdict for ``pages(page_id, url[, html])``.

    ``labels(page_id, bad)`` may give outcomes; else a page that a rule decides is labelled by the rule, and any other
    by whether its url or its html has one of ``bad_terms``, A-Z in either case. A null or malformed url has empty host and path, no rule, and is
    allowed unless such urls as a group have a bad reputation. Repeated rows are judged alike and each kept.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    content = [F.coalesce(F.col(c), F.lit("")) for c in ("url", "html") if c in pages.columns]
    bad = F.regexp_like(F.concat(*content), F.lit(f"(?i){'|'.join(bad_terms)}")) if bad_terms else F.lit(False)
    base = pages.select("page_id", host.alias("host"), path.alias("path"), bad.alias("bad"))
    base = base.select("page_id", "host", "path", "bad", _longest(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]).alias("rule"), _longest(rules, F.col("host"), F.col("path"), lambda r: r[0]).alias("ruled"))
    if labels is None:
        outcomes = base.select("host", F.coalesce((F.col("ruled") == "block"), F.col("bad")).cast("int").alias("bad"))
    else:
        outcomes = base.select("page_id", "host").join(labels.select("page_id", "bad"), "page_id").select("host", "bad")
    known = reputation(outcomes).select("host", "blocked")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return base.join(known, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
