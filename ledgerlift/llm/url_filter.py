"""URL filters: block and allow rules, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes (bad or not) are counted per host, registered domain (the suffix and one label before it) and
suffix (the last label, or the last two where these are a common public suffix, SUFFIXES). From the top down every level's share of bad pages is shrunk towards its parent's: the prior is a beta
distribution whose mean is the parent's posterior mean and whose strength is estimated, by the method of moments for
beta-binomial counts, from how far the level's members scatter around their parents. A page is blocked if the lower
bound of its host's posterior lies above BLOCK; a host without labelled pages has its domain's posterior as its
prior, and so on up. All counts are map-side combined aggregates; only the three strengths and the overall share come
to the driver.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule, and is judged by the overall
posterior; a null page_id is kept; repeated rows are judged each; without labelled pages nothing is blocked by
reputation; only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

# Verdict, host and path start of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Public suffixes of two labels.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "co.nz", "net.nz", "org.nz", "com.br", "gov.br", "net.br", "org.br", "ac.za", "co.za", "org.za", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "ac.in", "co.in", "net.in", "org.in",
    "com.mx", "org.mx", "ac.kr", "co.kr", "or.kr", "com.tr", "org.tr", "com.ar", "com.sg", "com.hk", "com.tw", "com.ua", "co.il", "co.id", "co.th", "com.my", "com.pl", "com.rs", "co.rs",
)
#: A host is blocked if its share of bad pages is above BLOCK with this many standard deviations to spare.
BLOCK, SPARE = 0.5, 1.645
#: Bounds of the estimated strengths, and the counts that stand before the overall share.
WEAKEST, STRONGEST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none. Rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def strength(level: DataFrame) -> float:
    """Of a level (n, bad, mean: its parents' posterior means) the beta prior's strength, by the method of moments."""
    spread = F.col("mean") * (1 - F.col("mean"))
    seen = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("seen")
    row = level.agg(seen, F.sum(spread).alias("base"), F.sum(spread * (F.col("n") - 1)).alias("slope")).first()
    if not row["slope"] or row["slope"] <= 0:
        return STRONGEST
    rho = (row["seen"] - row["base"]) / row["slope"]
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes (host, bad) -> one row per host: host, and the lower bound of its posterior share of bad pages.

    Hosts that the outcomes lack but the caller has may be given with bad null: they count as nothing."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = ((every["bad"] or 0) + 0.5) / ((every["n"] or 0) + 1.0)

    def posterior(level: DataFrame) -> DataFrame:
        k = F.lit(strength(level.where("n > 0")))
        return level.withColumns({"a": k * F.col("mean") + F.col("bad"), "b": k * (1 - F.col("mean")) + F.col("n") - F.col("bad")})

    share = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = posterior(suffixes.withColumn("mean", F.lit(top)))
    domains = posterior(domains.join(small(suffixes.select("suffix", share.alias("mean"))), "suffix"))
    hosts = posterior(hosts.drop("suffix").join(small(domains.select("domain", share.alias("mean"))), "domain"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return stored(hosts.select("host", (share - SPARE * deviation).alias("bound")), "reputation")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and bound of every page. labels (page_id of a labelled page, bad 0 or 1) may repeat."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    # A page shows the document whose number ends its path.
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long")
    labels = stored(labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad")), "page-labels")
    shown = read.select("host", number.alias("doc_id"))
    # Pages without a number are no key of the join; they bring their hosts alone.
    told = shown.where("doc_id is not null").join(labels, "doc_id", "left").select("host", "bad")
    known = reputation(told.unionByName(shown.where("doc_id is null").select("host", F.lit(None).cast(labels.schema["bad"].dataType).alias("bad"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("told")).join(small(known), "host", "left")
    own = F.when(F.col("bound") > BLOCK, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", own).alias("verdict"), "bound")


def bad_documents(labels: DataFrame) -> DataFrame:
    """doc_id and bad (1: toxic or of low quality) of labelled documents."""
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))
    return labels.select("doc_id", F.when(bad > 0, 1).otherwise(0).alias("bad"))
