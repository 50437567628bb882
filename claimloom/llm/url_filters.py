"""URL filters with redirect equivalence.

Explicit rules decide first: a rule names a host (and so its subdomains) and a path prefix; the longest fitting rule wins.
Pages without a fitting rule take part in redirect equivalence: nodes are canonical URLs, edges come from canonical links
and refresh redirects in the HTML and from the URL forms that redirect to the same place (scheme, default port, fragment,
trailing slash, `.html`, `www.` and `m.` hosts, the order of query parameters, parameters for tracking and paging). Other query
parameters tell pages apart. Block decisions of explicit rules spread over each connected component. Allow takes precedence: a
component in which any URL is explicitly allowed passes no block on, and an explicitly allowed page stays allowed in any
component.

Everything is DataFrame functions. The rule list is a parameter, a bounded list in the plan.

Defined results: null URLs and URLs without `://` have empty host and path, fit no rule, form no edges and are allowed; null
HTML has no edges; repeated pages and pages sharing a URL share their decision; an empty table gives no rows; other columns
are kept, whatever their names. Hosts are lower-cased in A-Z only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.columns import unused
from claimloom.llm.graph import components
from claimloom.storage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: HTML that redirects or names a canonical address; one capture for the tag.
CANONICAL_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Query parameters that lead to the same page: tracking, sessions and paging.
SAME_PAGE = r"^(utm_[^=]*|gclid|fbclid|msclkid|mc_[ce]id|ref|referrer|sid|sessionid|phpsessid|page|p|offset|start)(=|$)"
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, lower-cased; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Position in `rules` of the longest fitting one, or null."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), rules[k].text))
    found = F.lit(None).cast("int")
    for k in reversed(order):
        rule = rules[k]
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, k).otherwise(found)
    return found


def canonical_url(url: Column) -> Column:
    """The address to which the usual redirects lead: host without `www.` or `m.`, path without `.html` and end slashes, the
    query's parameters in order without those of SAME_PAGE."""
    plain = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(SAME_PAGE))), "&")
    return F.concat(plain, F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _targets(html: Column, url: Column, host: Column) -> Column:
    """Absolute targets of canonical links and refresh redirects; an array, mostly empty."""
    raw = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(CANONICAL_TAG), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH_TAG), 0), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    )
    found = F.when(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"), raw).otherwise(F.array().cast("array<string>"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    absolute = F.transform(
        F.filter(found, lambda t: t != ""),
        lambda t: F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.startswith("/"), F.concat(scheme, host, t)).otherwise(F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^?#]*/)", 1), t)),
    )
    return F.filter(absolute, lambda t: t.contains("://"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with host, path, rule and verdict; see the module's text for the meaning."""
    address = F.col(url)
    at, node, own, spread = unused(pages, "at", "node", "own", "spread")
    names = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    host, path = host_of(address), path_of(address)
    seen = pages.withColumns({at: rule_index(host, path, rules), node: F.when(host != "", canonical_url(address))})
    # host and path come last, as they may take the place of a column that the others are made from
    facts = seen.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.get(verdicts, F.col(at)).alias("own"), address.alias("url"), host.alias("host"), F.col(html).alias("html"))
    links = facts.select("node", F.explode(_targets(F.col("html"), F.col("url"), F.col("host"))).alias("to"))
    links = materialize(links.select(F.col("node").alias("a"), canonical_url(F.col("to")).alias("b")), "links")
    reached = components(links)
    flags = lambda verdict: [(verdict == v).cast("int").alias(v) for v in ("block", "allow")]
    own_verdict = facts.where(F.col("own").isNotNull()).select("node", *flags(F.col("own"))).groupBy("node").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    target = links.select(F.col("b").alias("node")).distinct()
    ruled = target.withColumn("at", rule_index(F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules))
    target_verdict = ruled.where(F.col("at").isNotNull()).select("node", *flags(F.get(verdicts, F.col("at"))))
    decided = own_verdict.union(target_verdict).join(reached, "node", "left")
    parts = decided.groupBy(F.coalesce("component", "node").alias("component")).agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    blocked = parts.where("block = 1 and allow = 0").select("component").join(reached, "component", "left")
    blocked = blocked.select(F.coalesce("node", "component").alias(node), F.lit("block").alias(spread))
    out = seen.join(blocked, node, "left").withColumns({own: F.get(verdicts, F.col(at)), "rule": F.get(names, F.col(at)), "host": host, "path": path})
    return out.withColumn("verdict", F.coalesce(own, spread, F.lit("allow"))).drop(at, node, own, spread)
