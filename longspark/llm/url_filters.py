"""URL rules, and block decisions carried along redirects and canonical links.

Pages that redirect to each other or name each other as canonical are aliases: the components of the
link graph. An explicit rule on a page's own URL decides. Else, within its component, an explicit allow
outranks every block, and a block anywhere blocks all aliases that have no rule. All of it is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import ascii_lower
from longspark.llm.components import connected_components
from longspark.session import materialize

#: (host, path, verdict); a short list, part of the plan.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_NOISE = r"(?is)<!--.*?-->|<script\b.*?</script>"
_TAG = r"(?i)<(?:link|meta)\s[^>]*>"
_CANONICAL = r"""(?i)\srel\s*=\s*["']?canonical\b"""
_REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``; A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """What names a URL in the link graph: scheme and host in lower case, no fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host(url), rest))


def matching_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _absolute(target: Column, url: Column) -> Column:
    """A link target as an absolute URL; null for other kinds of target."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    folder = F.concat(site, F.regexp_extract(F.concat(path(url), F.lit("")), r"(?s)^(.*/)?", 1))
    return (
        F.when(target.rlike(r"(?i)^https?://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.rlike(r"^[?#]"), F.concat(site, path(url), target))
        .otherwise(F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Redirects (meta refresh) and canonical links of the pages: (source, target), no loops.

    Comments and scripts are not looked at. Null URLs or pages give no edges.
    """
    body, own = F.col(html), F.col(url)
    tags = F.regexp_extract_all(F.regexp_replace(body, _NOISE, ""), F.lit(_TAG), 0)
    rows = (
        pages.where(own.contains("://") & body.rlike(r"(?i)canonical|http-equiv"))
        .select(own.alias("url"), F.explode(tags).alias("tag"))
        .select(
            "url",
            F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1))
            .when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1))
            .alias("to"),
        )
        .where("to <> ''")
    )
    rows = rows.withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    rows = rows.select(node(F.col("url")).alias("source"), node(_absolute(F.col("to"), F.col("url"))).alias("target"))
    return rows.where("source <> target").distinct()


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """Each page row with ``host``, ``path``, ``rule`` and ``verdict``; its ``html`` is left out.

    The verdict is the rule's; without a rule it is ``allow`` or ``block`` by the page's aliases, and
    ``allow`` where no alias has a rule. Pages without a URL have empty host and path, no rule and no
    aliases. Targets that are no page themselves count as aliases too. Equal rows stay apart, other
    columns are kept, columns of the given names are replaced.
    """
    edges = materialize(link_edges(pages, url, html))
    nodes = connected_components(edges, "source", "target")
    _, decided = matching_rule(host(F.col("node")), path(F.col("node")), rules)
    groups = nodes.groupBy("component").agg(
        F.max(F.coalesce(decided == "allow", F.lit(False))).alias("_allow"),
        F.max(F.coalesce(decided == "block", F.lit(False))).alias("_block"),
    )
    aliases = materialize(nodes.join(groups, "component").select(F.col("node").alias("_node"), "_allow", "_block"))

    kept = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict")]
    rows = pages.select(*kept, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_own": verdict})
    # pages without a node get keys of their own, so that they do not meet in one task
    spread = F.concat(F.lit("\0"), F.xxhash64(*kept).cast("string"))
    rows = rows.withColumn("_node", F.coalesce(node(F.col(url)), spread)).join(aliases, "_node", "left")
    by_alias = F.when(F.col("_allow"), "allow").when(F.col("_block"), "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("_own", by_alias)).select(*kept, "host", "path", "rule", "verdict")
