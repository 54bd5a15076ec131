"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. Beta-binomial priors shrink them level by level:
a suffix towards the whole, a registered domain towards its suffix, a host towards its
domain, each with a strength estimated from how much the groups of that level differ. A page
is blocked where even the lower posterior bound of its host's share of bad pages is high.
DataFrame expressions only; a hot host costs one row per task and one split join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (host, path, verdict): fits the host and its subdomains where the path starts so.
RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Public suffixes of two labels, below which domains are registered.
SUFFIXES: tuple[str, ...] = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.uy", "com.ve", "com.vn", "edu.au", "edu.cn",
    "gob.mx", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.uk", "org.nz", "github.io",
)
#: What stands for the suffix of an address.
ADDRESS = "#address"
#: A host is blocked if its share of bad pages is above this, Z standard deviations of the
#: posterior taken off. Prior strengths stay within these limits (in pages).
BLOCK_ABOVE, Z, MIN_STRENGTH, MAX_STRENGTH = 0.5, 1.645, 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; else null."""
    found = F.lit(None)
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bare(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the public suffix and one label more; an address is its own."""
    bare = _bare(host)
    name = F.when(F.substring_index(bare, ".", -2).isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(_is_address(bare), bare).otherwise(name)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: two labels if they are among ``suffixes``, else the last one."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_is_address(bare), ADDRESS).when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def _level(counts: DataFrame) -> tuple[float, float]:
    """(share of bad pages, prior strength) by moments over the groups ``n, bad`` of a level."""
    p = F.col("bad") / F.col("n")
    total, bad, groups, squares, weighted = counts.agg(F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * p * p)).first()
    if not total:
        return 0.5, MAX_STRENGTH
    share = bad / total
    variance = share * (1 - share)
    between = weighted - total * share * share
    room = variance * (total - squares / total - (groups - 1))
    rho = (between - variance * (groups - 1)) / room if room > 0 else 0.0
    return share, min(MAX_STRENGTH, max(MIN_STRENGTH, (1 - rho) / rho)) if rho > 0 else MAX_STRENGTH


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """From labelled pages ``host, bad`` (0 or 1): ``host, n, bad, mean, low`` for each host.

    ``mean`` and ``low`` are the posterior mean of the share of bad pages and its lower bound.
    A host is shrunk towards its registered domain, that towards its public suffix; addresses
    are domains of their own under one suffix, and ports and users don't count for either.
    Rows with a null host or outcome don't count. No outcomes give an empty table.
    """
    valid = outcomes.where("host is not null and bad is not null")
    hosts = materialize(valid.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "url-hosts")
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (root, by_suffix), (_, by_domain), (_, by_host) = _level(suffixes), _level(domains), _level(hosts)
    of_suffix = suffixes.select("suffix", ((F.col("bad") + by_suffix * root) / (F.col("n") + by_suffix)).alias("above"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", ((F.col("bad") + by_domain * F.col("above")) / (F.col("n") + by_domain)).alias("above"))
    size = F.col("n") + by_host
    mean = (F.col("bad") + by_host * F.col("above")) / size
    return (
        hosts.join(of_domain, "domain")
        .select("host", "n", "bad", mean.alias("mean"), size.alias("_size"))
        .select("host", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_size") + 1))).alias("low"))
    )


def judge_urls(pages: DataFrame, reputation: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, low``.

    The longest rule that fits decides; without one a page is blocked if its host's ``low``
    is above ``block_above`` and allowed otherwise, also where nothing is known of the host.
    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed.
    Repeated rows are judged one by one; an empty table gives no rows. A long url counts whole.
    Only the two columns named are read, so others can't clash.
    """
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = materialize(reputation.select("host", "low"), "url-reputation")
    found = rule_for(F.col("host"), F.col("path"), rules)
    return (
        parsed.join(known, "host", "left")
        .select("id", "host", "path", "low", found.alias("_found"))
        .select("id", "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.when(F.col("low") > block_above, "block").otherwise("allow")).alias("verdict"), "low")
    )
