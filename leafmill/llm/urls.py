"""URL filters over redirect equivalence, in DataFrame functions only.

Rules name a host (with its subdomains) and the beginning of a path; the longest rule that fits decides, allow before block at
equal length.  Pages without a rule take the decision of their aliases: pages and link targets that redirects (``meta
refresh``) and canonical links connect form components; a component with an explicitly allowed member is allowed, else one with
a blocked member is blocked, else it is allowed.

An address is compared without scheme and fragment and with its host in lower case.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; it is no alias of
anything.  Null html has no links; links to nowhere (empty, ``javascript:``, ``mailto:``) are ignored; repeated rows are judged
alike; without pages there is no row, without rules everything is allowed and no rule is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.components import connected_components
from leafmill.staging import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host in lower case, path and query: what two spellings of one page share.  Null without ``://``."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def links_of(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects, as written."""
    quoted = r"""(?is)\s{0}\s*=\s*["']?([^"'\s>]+)"""
    canon = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?is)\srel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    fresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?is)\shttp-equiv\s*=\s*["']?refresh\b"""))
    found = F.concat(
        F.transform(canon, lambda t: F.regexp_extract(t, quoted.format("href"), 1)),
        F.transform(fresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    plain = F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return F.filter(plain, lambda x: (x != "") & ~x.rlike(r"(?i)^(javascript|mailto|data|tel):"))


def resolved(link: Column, url: Column) -> Column:
    """A link as seen from url."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    path = path_of(url)
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1)).otherwise("/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
        .when(link.startswith("?"), F.concat(scheme, F.lit("://"), host, path, link))
        .when(~link.startswith("#"), F.concat(scheme, F.lit("://"), host, folder, link))
    )


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.  rules: (verdict, host, path beginning)."""
    kind = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(kind)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the address of a page and of a page it points to as itself."""
    own = pages.select(F.col(url).alias("url"), F.explode(links_of(F.col(html))).alias("link"))
    own = own.select(address_of(F.col("url")).alias("a"), address_of(resolved(F.col("link"), F.col("url"))).alias("b"))
    return own.filter("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    own = own.select("page_id", address_of(F.col("url")).alias("address"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    links = materialize(alias_links(pages, url, html), "links")
    groups = materialize(connected_components(links), "aliases")
    # A component's members carry their own rules, whether or not a page of that address is in the table.
    spelled = F.concat(F.lit("x://"), F.col("node"))
    hit = rule_for(host_of(spelled), path_of(spelled), rules)["verdict"]
    rank = F.when(hit == "allow", 2).when(hit == "block", 1).otherwise(0)
    decided = groups.groupBy("component").agg(F.max(rank).alias("rank")).filter("rank > 0")
    decided = materialize(decided, "decided")
    by_address = materialize(groups.join(decided, "component").select(F.col("node").alias("address"), "rank"), "by-address")
    out = own.join(by_address, "address", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("hit")["rule"].alias("rule"),
        F.coalesce(F.col("hit")["verdict"], F.when(F.col("rank") == 1, "block").otherwise("allow")).alias("verdict"),
    )
