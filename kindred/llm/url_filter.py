"""Allow or block urls by rules and by the reputation of their host.

Reputation is empirical Bayes. Of the labelled pages of a suffix (the last
label of a host), a registered domain (the last two) and a host, some are
bad. Each level's rate gets a beta prior: its mean is the posterior mean of
the level above, its weight is fitted by moments from how much the groups
of that level differ. The top level's prior mean is the rate over all
labels. A page is blocked if even the lower bound of its host's posterior
(mean less z standard deviations) has odds of more than `times` those of
the rate over all labels: what counts is by how much a host is worse than
the rest, whatever the outcome that the labels state.

The registered domain is a host's last two labels, or one more than the
suffixes given have: with ("co.uk",), a.co.uk and b.co.uk are two domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut

#: (verdict, host, path). Fixed values of the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
Z, TIMES = 1.64, 3.0
MIN_WORDS, MIN_LETTERS = 20, 0.7


def host_path(url: Column) -> tuple[Column, Column]:
    """Both empty if url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def bad_page(html: Column) -> Column:
    """A page outcome by its own content: too few visible words, or too few letters among the visible characters."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    shown = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return (words < MIN_WORDS) | (letters < MIN_LETTERS * shown)


def _weight(groups: DataFrame) -> float:
    """Weight of a beta prior by moments (Kleinman 1973) from rows n, bad, mean: one row comes to the driver."""
    g = groups.agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) / F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(1e-6))).alias("s"),
    ).first()
    if not g or not g["n"]:
        return 1.0
    spare = g["n"] - g["n2"] / g["n"] - (g["g"] - 1)
    rho = (g["s"] - (g["g"] - 1)) / spare if spare > 0 else 0.0
    return min(1e4, max(1.0, (1 - rho) / rho)) if rho > 0 else 1e4


def reputation(outcomes: DataFrame, *, z: float = Z, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """host, mean, bound, overall from rows (host, bad boolean): one row for each host with a label; null outcomes don't count.

    suffixes: those of several labels; all others have one.
    """
    label = lambda k: F.regexp_extract("host", rf"(?:^|\.)([^.]*(?:\.[^.]*){{{k}}})$", 1)
    hosts = outcomes.filter("bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = cut(hosts)  # every level and prior reads it: the pages are judged once
    suffix, domain = label(0), F.when(F.instr("host", ".") > 0, label(1)).otherwise(F.col("host"))
    for x in sorted(suffixes, key=lambda x: x.count(".")):
        under, k = (F.col("host") == x) | F.endswith(F.col("host"), F.lit("." + x)), x.count(".") + 1
        suffix, domain = F.when(under, F.lit(x)).otherwise(suffix), F.when(F.col("host") == x, F.col("host")).when(under, label(k)).otherwise(domain)
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    total = hosts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    top = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    above = None
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [level] if parent in (None, level) else [level, parent]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.withColumn("mean", F.lit(top)) if above is None else groups.join(above.select(F.col(parent), F.col("post").alias("mean")), parent)
        w = _weight(groups)
        a, b = F.col("mean") * w + F.col("bad"), (1 - F.col("mean")) * w + F.col("n") - F.col("bad")
        above = groups.withColumns({"post": a / (a + b), "sd": F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))})
    return above.select("host", F.col("post").alias("mean"), (F.col("post") - z * F.col("sd")).alias("bound"), F.lit(top).alias("overall"))


def url_filter(urls: DataFrame, outcomes: DataFrame, *, rules=RULES, z: float = Z, times: float = TIMES, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound for each row of urls (page_id, url).

    outcomes: rows (host, bad), labels of pages. Of the rules whose host is
    the url's or above it and whose path begins the url's, the longest (host
    and path together) decides, then the first listed; without one, the
    posterior does. A host without labels is allowed. Null urls and urls
    without ``://`` have host and path "", and go by that host's labels.
    """
    host, path = host_path(F.col("url").cast("string"))
    pages = urls.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    fits = lambda h, p: ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
    rule = judged = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        rule = F.when(fits(h, p), h + p) if rule is None else rule.when(fits(h, p), h + p)
        judged = F.when(fits(h, p), verdict) if judged is None else judged.when(fits(h, p), verdict)
    known = reputation(outcomes, z=z, suffixes=suffixes)
    out = pages.withColumns({"rule": F.lit(None).cast("string") if rule is None else rule, "ruled": F.lit(None).cast("string") if judged is None else judged}).join(known, "host", "left")
    odds = times * F.col("overall") / (1 - F.col("overall"))
    method = F.when(F.col("bound") > odds / (1 + odds), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("mean").alias("bad_rate"), "bound")
