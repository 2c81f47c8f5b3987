"""URL filter: host and path rules, and block decisions carried over to aliases.

Redirects and canonical links make addresses aliases of each other. Groups of aliases are the connected
components of those edges, found by joins; a group with a blocked address and no allowed one blocks
its members that no rule judges. Everything is DataFrame expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import staged
from clearlines.llm.components import connected_components

#: Rules become one expression; longer lists belong in a table.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """``site`` is a host and a path prefix, such as ``example.net/en/``; ``verdict`` is allow or block."""

    site: str
    verdict: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"),
         Rule("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
_CANONICAL = r"(?is)(?<![\w-])rel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"
_REFRESH = r"(?is)(?<![\w-])http-equiv\s*=\s*[\"']?\s*refresh\b"
#: The target within a refresh's content, which may have quotes of its own.
_MOVED = r"(?is)\burl\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\"'\s>]+))"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the URL is NULL."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """An address without its fragment, host in lower case: what makes two URLs the same. NULL without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(
        scheme, F.lit("://"), host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Site of the longest rule that fits, else NULL. Of equally long ones, the first fits first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.site))
            for r in sorted(rules, key=lambda r: -len(r.site))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def verdict_of(site: Column, rules: tuple[Rule, ...]) -> Column:
    """The verdict of a rule's site, NULL for none."""
    found = F.lit(None).cast("string")
    for rule in rules:
        found = F.when(site == rule.site, F.lit(rule.verdict)).otherwise(found)
    return found


def _one_of_three(text: Column, pattern: str) -> Column:
    """The group of a pattern of three alternatives that matched, trimmed; empty if none did."""
    return F.trim(F.concat(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]))


def _attribute(tag: Column, name: str) -> Column:
    return _one_of_three(tag, rf"(?is)(?<![\w-]){name}{_VALUE}")


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^<>]*>"), F.lit(0))


def _moved(tag: Column) -> Column:
    content = F.regexp_replace(F.regexp_replace(_content(tag), "&quot;|&#34;", '"'), "&apos;|&#39;", "'")
    return _one_of_three(content, _MOVED)


def _content(tag: Column) -> Column:
    """The content attribute; without quotes around it, it ends at white space."""
    return _one_of_three(tag, r"(?is)(?<![\w-])content\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>][^\s>]*))")


def page_links(html: Column) -> Column:
    """As an array: the targets of all canonical links and refresh redirects of a page."""
    low, none = F.lower(html), F.array().cast("array<string>")
    links = F.filter(_tags(html, "link"), lambda tag: tag.rlike(_CANONICAL))
    moves = F.filter(_tags(html, "meta"), lambda tag: tag.rlike(_REFRESH))
    canonical = F.when(low.contains("canonical"), F.transform(links, lambda tag: _attribute(tag, "href"))).otherwise(none)
    refresh = F.when(low.contains("http-equiv"), F.transform(moves, _moved)).otherwise(none)
    return F.array_distinct(F.filter(F.concat(canonical, refresh), lambda link: link != ""))


def page_base(html: Column) -> Column:
    """The href of the first base tag that has one, else NULL."""
    found = F.filter(F.transform(_tags(html, "base"), lambda tag: _attribute(tag, "href")), lambda link: link != "")
    return F.when(F.lower(html).contains("<base"), F.get(found, F.lit(0)))


def without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its segments ``.`` and ``..`` resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array().cast("array<string>"), lambda done, part: F.when(
        part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(
        F.concat(done, F.array(part))))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def absolute(url: Column, link: Column) -> Column:
    """A link's address, relative ones resolved against ``url`` (RFC 3986). NULL for schemes without ``://``."""
    link, scheme = F.replace(link, F.lit("&amp;"), F.lit("&")), F.substring_index(url, "://", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    root = F.concat(scheme, F.lit("://"), host_of(url))
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*([^#]*)", 1)
    target = (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
              .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
              .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
              .when(link.startswith("/"), F.concat(root, link))
              .when(link.startswith("?"), F.concat(root, path, link))
              .when(link.startswith("#"), F.concat(root, path, query, link))
              .otherwise(F.concat(root, F.regexp_extract(path, "^.*/", 0), link)))
    straight = F.concat(F.substring_index(target, "://", 1), F.lit("://"), F.regexp_extract(after_scheme(target), "^[^/?#]*", 0),
                        without_dots(path_of(target)), F.regexp_extract(after_scheme(target), r"^[^?#]*(.*)$", 1))
    return F.when(F.instr(url, "://") > 0, F.when(path_of(target).contains("/."), straight).otherwise(target))


def _node(place: Column) -> Column:
    return F.unhex(F.md5(place.cast("binary")))


def _ruled(rows: DataFrame, url: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``place`` (the address) and ``node`` step by step, so that none is worked out twice."""
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "place": address(F.col(url))})
    return rows.withColumns({"rule": matching_rule(F.col("host"), F.col("path"), rules), "node": _node(F.col("place"))})


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``source, target`` addresses from the pages' links and from a table (``source, target``) of redirects."""
    # exploding and writing the few links found keeps the patterns from being worked out again
    found = staged(pages.select(F.col(url).alias("source"), page_base(F.col(html)).alias("base"),
                                F.explode(page_links(F.col(html))).alias("link")), "page-links")
    base = F.coalesce(absolute(F.col("source"), F.col("base")), F.col("source"))
    edges = found.withColumn("base", base).select("source", absolute(F.col("base"), F.col("link")).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = staged(edges.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target")), "aliases")
    return edges.where(F.col("source") != F.col("target"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None,
               key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, host, path, rule, verdict, aliased`` of every row of ``pages``.

    The verdict is that of the longest fitting rule. Without one it is ``block`` if the page has a blocked
    alias and no allowed one, else ``allow``; an alias may be an address that is not itself a page.
    NULL URLs and those without ``://`` have empty host and path, no rule and no alias. NULL html has no link.
    NULL and repeated keys and rows give a row each; the same address on many pages is one node. An
    empty table gives no rows. Only the three columns are read.
    """
    edges = alias_edges(pages, redirects, url, html)
    groups = connected_components(edges.select(_node(F.col("source")).alias("left"), _node(F.col("target")).alias("right")))
    ends = edges.select(F.col("source").alias("url")).unionByName(edges.select(F.col("target").alias("url")))
    ruled = _ruled(ends, "url", rules).select("node", verdict_of(F.col("rule"), rules).alias("verdict"))
    ruled = ruled.where(F.col("verdict").isNotNull()).distinct()
    decided = ruled.join(groups, "node").groupBy("component").agg(
        F.min(F.when(F.col("verdict") == "allow", F.lit("allow")).otherwise(F.lit("block"))).alias("carried"))
    carried = groups.join(decided, "component").select("node", "carried")
    # few nodes have aliases; the pages' own addresses are unique but for repeated pages, which a
    # salt spreads when one address holds a large share of the rows
    salted = carried.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    judged = _ruled(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url", rules).select(
        "key", "host", "path", "rule", "node", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int").alias("salt"))
    both = judged.join(salted, ["node", "salt"], "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("carried"), F.lit("allow"))
    aliased = F.col("carried").isNotNull()
    return both.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), aliased.alias("aliased"))
