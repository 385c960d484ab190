"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted for each host, registered domain and suffix. At every level a
beta-binomial prior has the mean of the level above and a strength estimated from how far the level's rates scatter
(moment estimate of the intra-class correlation). So a host with few labelled pages takes its domain's rate, a domain
with few its suffix's, and a suffix with few that of all pages. A host is blocked if the lower bound of its posterior
rate of bad pages, `Z` standard deviations under the mean, is above `LIMIT`.

The suffix is public_suffixes()' longest entry that the host ends with (the list that Apache HttpClient, which Spark
ships, carries; another can be given), else the last label; the registered domain has one label more. User information
and ports don't count for them; an address made of numbers is its own domain and suffix. Defined results: null urls and
such without :// have an empty host and path, which is a host like any other; pages that share an id share its outcome;
a page_id that is null has no outcome; no outcomes at all block nothing; of rules that fit with the same length the one
of the smallest host, path and verdict holds, however many rules there are; an empty table gives no rows; other columns
than page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

LIMIT, Z, STRENGTHS = 0.25, 1.0, (1.0, 10000.0)
#: Up to so many rules become one expression; more are joined by host suffix.
INLINE = 256


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.col(url).substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def split(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    host, path = host_and_path("url")
    return pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))


@cache
def _listed(text: str) -> tuple[str, ...]:
    rules = []
    for line in text.splitlines():
        rule = line.split(maxsplit=1)[0].lower() if line.strip() and not line.startswith("//") else ""
        if rule:
            rules.append(rule)
            if not rule.isascii():
                try:
                    rules.append(".".join(x if x in "*" else x.encode("idna").decode() for x in rule.split(".")))
                except UnicodeError:
                    pass
    return tuple(dict.fromkeys(rules))


def public_suffixes(spark: SparkSession) -> tuple[str, ...]:
    """The rules of the public suffix list on the JVM's class path (some 9,000: names, *.names and !exceptions); none
    where a build leaves it out."""
    jvm = spark._jvm
    found = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResource("mozilla/public-suffix-list.txt")
    return _listed(jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")) if found else ()


def with_domains(hosts: DataFrame, rules: Iterable[str]) -> DataFrame:
    """hosts (host, ...), a row for each host, with domain and suffix. The rules are a list of a known size (some
    10,000), and so are broadcast."""
    spark = hosts.sparkSession
    name = F.regexp_replace(F.regexp_replace("host", "^[^@]*@", ""), r":\d*$|\.$", "")
    base = hosts.withColumn("_name", name).withColumn("_labels", F.split("_name", r"\."))
    n = F.size("_labels")
    number = F.col("_name").rlike(r"^\d+(\.\d+){3}$|^\[")
    table = []
    for r in rules:
        tail = r.lstrip("!").removeprefix("*.")
        size = tail.count(".") + 1
        table.append((tail, 1, size - 1) if r.startswith("!") else (tail, 0, size + 1) if r.startswith("*.") else (tail, 0, size))
    if table:
        values = ", ".join("('{}', {}, {})".format(t.replace("'", "''"), e, k) for t, e, k in table)
        known = spark.sql(f"SELECT tail, struct(except, labels) found FROM VALUES {values} AS t(tail, except, labels)")
        up = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice("_labels", k, n), "."))
        best = base.select("host", n.alias("n"), F.explode(up).alias("tail")).join(F.broadcast(known), "tail").filter("found.labels <= n")  # *.name needs one label more
        base = base.join(best.groupBy("host").agg(F.max("found").alias("_found")), "host", "left")
    else:
        base = base.withColumn("_found", F.lit(None).cast("struct<except:int,labels:int>"))
    size = F.coalesce("_found.labels", F.lit(1))
    last = lambda k: F.when(number, F.col("_name")).otherwise(F.array_join(F.slice("_labels", F.greatest(n - k + 1, F.lit(1)), k), "."))
    return base.withColumn("suffix", last(size)).withColumn("domain", last(size + 1)).drop("_name", "_labels", "_found")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) that fits, as struct(rule, verdict); null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (host, path, ...) with rule and rule_verdict."""
    if len(rules) <= INLINE:
        return pages.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("r.rule")).withColumn("rule_verdict", F.col("r.verdict")).drop("r")
    table = pages.sparkSession.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, v string")
    hosts = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hits = hosts.select("host", "path", F.explode(up).alias("rule_host")).join(table, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.min(F.struct(F.negative(F.length(rule)).alias("size"), "rule_host", "rule_path", "v")).alias("r"))
    return pages.join(best, ["host", "path"], "left").withColumn("rule", F.concat("r.rule_host", "r.rule_path")).withColumn("rule_verdict", F.col("r.v")).drop("r")


def _strength(counts: DataFrame, within: str) -> DataFrame:
    """One row: the strength of a level's prior, from counts of (bad, n) and the level above's rate m."""
    n, p, m = F.col("n"), F.col("bad") / F.col("n"), F.col("m")
    a = counts.filter("n > 0").agg(F.sum(n).alias("all"), F.sum(n * n).alias("sq"), F.count(F.lit(1)).alias("k"), F.sum(n * (p - m) * (p - m)).alias("s"), F.sum(n * m * (1 - m)).alias("v"))
    pq = F.col("v") / F.col("all")
    rho = (F.col("s") - pq * (F.col("k") - 1)) / (pq * (F.col("all") - F.col("sq") / F.col("all") - F.col("k") + 1))
    rho = F.when((pq > 0) & (F.col("all") - F.col("sq") / F.col("all") - F.col("k") + 1 > 0), rho)
    low, high = STRENGTHS
    value = F.coalesce(F.when(rho <= 1 / (1 + high), F.lit(high)).when(rho >= 1 / (1 + low), F.lit(low)).otherwise((1 - rho) / rho), F.lit(high))
    return a.select(value.alias(within))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Iterable[str] | None = None) -> DataFrame:
    """host, n, bad, mean, bound for every host of pages (from split()); outcomes: page_id, bad. Staged."""
    suffixes = public_suffixes(pages.sparkSession) if suffixes is None else suffixes
    known = outcomes.filter("page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    j = pages.select("page_id", "host").join(known, "page_id", "left")
    counted = stage(j.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "counts")
    host = stage(with_domains(counted, suffixes), "hosts")
    whole = host.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("m"))
    up = whole
    for level, above in (("suffix", []), ("domain", ["suffix"]), ("host", ["domain", "suffix"])):
        own = host.groupBy(level, *above).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        own = own.join(F.broadcast(up), F.lit(True)) if not above else own.join(up.withColumnRenamed("mean", "m").select(above[0], "m"), above[0])
        strength = _strength(own, "strength")  # one row
        own = own.join(F.broadcast(strength), F.lit(True))
        a, b = F.col("bad") + F.col("m") * F.col("strength"), F.col("n") - F.col("bad") + (1 - F.col("m")) * F.col("strength")
        up = own.select(level, *above, "n", "bad", a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))
        up = stage(up, level)
    mean, total = F.col("mean"), F.col("a") + F.col("b")
    return up.select("host", "n", "bad", "mean", (mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float = LIMIT, suffixes: Iterable[str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    p = split(pages)
    rep = reputation(p, outcomes, suffixes)
    j = with_rules(p, rules).join(rep.select("host", "mean", "bound"), "host", "left")
    method = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return j.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))
