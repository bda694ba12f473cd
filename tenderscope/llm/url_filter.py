"""URL filtering with redirect equivalence.

Rules judge hosts (with their subdomains) and path beginnings; the longest rule
wins. A page that no rule fits takes the decision of its aliases: pages joined
by redirects (meta refresh) and canonical links, followed to connected components
with a shuffle-based algorithm. Precedence is explicit: a page's own rule first;
then, among aliases, an allow beats a block; a page without any decision is allowed.
Nodes are URLs without scheme and fragment, so http and https variants are one node.
Link targets count as aliases even if they are no pages.

Defined cases
- Null url or none with ``://``: empty host and path, no rule, no aliases, allowed.
- Null html: no links. Links without a target, or to the page itself: none.
- Repeated rows are judged each; empty tables give empty results; extra columns pass through.
- Relative targets are resolved against the page's host and folder, ``.`` and ``..`` included; ``&amp;`` and its
  like are decoded. Links inside comments are none. ``rel`` may hold other words beside ``canonical``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderscope.llm.aliases import alias_groups
from tenderscope.llm.common import free_name

Rule = tuple[str, str, str]  # allow or block, host, path beginning


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL without scheme and fragment; null where there is no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and decision of the longest rule that fits; null where none does."""
    text = decision = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones are longer and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, decision = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(decision)
    return text, decision


def _resolved(url: Column) -> Column:
    """A URL whose path holds no ``.`` and ``..`` any more."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))  # the first is the empty part before the root
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    done = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step), "/")
    folder = F.when(path.rlike(r"/\.{1,2}$") & ~done.endswith("/"), F.concat(done, F.lit("/"))).otherwise(done)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(head, folder, rest)).otherwise(url)


def _decoded(c: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target``: nodes joined by a canonical link or a meta refresh."""
    html = F.col(f"`{html_col}`")
    shown = F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", "")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    named = r"(?is)\brel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)|\bhttp-equiv\s*=\s*[\"']?\s*refresh"
    wanted = F.filter(tags, lambda t: t.rlike(named))
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(F.col(f"`{url_col}`").alias("u"), F.explode(wanted).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    moved = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    target = _decoded(F.when(F.col("tag").rlike(r"(?i)^<link"), href).otherwise(moved))
    own = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    whole = (
        F.when(F.col("t").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("t"))
        .when(F.col("t").startswith("//"), F.concat(F.lit("http:"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(own, F.col("t")))
        .otherwise(F.concat(F.regexp_replace(folder, r"([^/])$", "$1/"), F.col("t")))
    )
    return (
        found.withColumn("t", target)
        .where(F.col("t") != "")
        .select(node_of(F.col("u")).alias("source"), node_of(_resolved(whole)).alias("target"))
        .where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
        .distinct()
    )


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, n_aliases``.

    ``redirects``: further ``source, target`` URLs. Columns of ``pages`` with the
    names of new ones give way to them.
    """
    new = ["host", "path", "rule", "verdict", "n_aliases"]
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(node_of(F.col("source")).alias("source"), node_of(F.col("target")).alias("target"))
        edges = edges.unionByName(more.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target"))))
    groups = alias_groups(edges)  # id, component: only URLs with a link
    host = F.regexp_extract("id", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("id", r"(?s)^[^/?#]*([^?#]*)", 1)
    judged = groups.select("id", "component", best_rule(host, path, rules)[1].alias("_d"))
    per = judged.groupBy("component").agg(
        F.bool_or(F.col("_d") == "allow").alias("_allow"), F.bool_or(F.col("_d") == "block").alias("_block"), F.count(F.lit(1)).alias("n_aliases")
    )
    said = F.when(F.col("_allow"), "allow").when(F.col("_block"), "block")
    # whatever the columns of the pages are called, these names are free
    node, passed, made = (free_name(pages.columns, x) for x in ("node__", "passed__", "made__"))
    passed_on = groups.join(per, "component").select(F.col("id").alias(node), F.struct(said.alias("said"), "n_aliases").alias(passed))
    u = F.col(f"`{url_col}`")
    rule, own = best_rule(host_of(u), path_of(u), rules)
    stay = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    judged_pages = pages.select(*stay, F.struct(host_of(u).alias("host"), path_of(u).alias("path"), rule.alias("rule"), own.alias("own")).alias(made), node_of(u).alias(node))
    out = judged_pages.join(passed_on, node, "left")
    mine, theirs = F.col(made), F.col(passed)
    return out.select(
        *stay,
        mine["host"].alias("host"),
        mine["path"].alias("path"),
        mine["rule"].alias("rule"),
        F.coalesce(mine["own"], theirs["said"], F.lit("allow")).alias("verdict"),
        F.coalesce(theirs["n_aliases"], F.lit(1)).cast("long").alias("n_aliases"),
    )
