"""The crawl as joins over a table of fetched pages ``(url, html)``.

Fetching is a source's matter; these operators decide what is fetched next.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import urls as U
from tessella.plans.materialize import checkpointed


def banned(url: Column, prefixes: list[str]) -> Column:
    """Whether the normalized URL starts with a banned prefix (a short list)."""
    out = F.lit(False)
    for p in prefixes:
        out = out | url.startswith(U.normal_url(p))
    return out


def links(pages: DataFrame) -> DataFrame:
    """``(url, link)``: distinct absolute http(s) links, without fragments."""
    quoted = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), 1)
    found = pages.select("url", F.explode(quoted).alias("raw"))
    bare = F.regexp_replace("raw", r"""^["']|["']$""", "")
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return found.select("url", U.joined(F.col("url"), F.trim(bare)).alias("link")).where("link is not null").distinct()


def admissible(urls: DataFrame, domains: list[str] | None = None, prefixes: list[str] = (), column: str = "url") -> DataFrame:
    """The enqueue filter: allowed domain, no banned prefix, an HTML page."""
    c = F.col(column)
    keep = U.is_html(c) & ~banned(U.normalized(c), list(prefixes))
    return urls.where(keep & U.domain(c).isin(domains) if domains is not None else keep)


def parsed(pages: DataFrame, main_text=None) -> DataFrame:
    """``(url, title, html)`` or, with a function of html, ``(url, title, text)``."""
    body = F.col("html") if main_text is None else F.coalesce(main_text(F.col("html")), F.lit(""))
    return pages.select("url", T.html_title(F.col("html")).alias("title"), body.alias("html" if main_text is None else "text"))


def crawl(pages: DataFrame, seeds: list[str], prefixes: list[str] = (), robots: DataFrame | None = None, agent: str = "tessella/1.0", max_depth: int | None = None) -> DataFrame:
    """``(url, depth)`` of the pages that a breadth-first crawl fetches.

    Level by level: the frontier is joined with the pages (a page that is
    absent failed and isn't marked visited), its links are filtered and those
    already seen are dropped.  ``robots(domain, rules)`` gates each domain; a
    domain without rules is closed.  Ends when the frontier is empty, or past
    ``max_depth`` if it is given.
    """
    spark = pages.sparkSession
    domains = sorted({re.split("[/?#]", s.split("://", 1)[-1], maxsplit=1)[0] for s in seeds})
    stored = pages.select(U.decoded("url").alias("url"), "html").dropDuplicates(["url"])
    frontier = spark.createDataFrame([(s,) for s in seeds], "url string").select(U.decoded("url").alias("url")).distinct()
    frontier = checkpointed(admissible(frontier, domains, prefixes))
    visited = None
    for depth in itertools.count() if max_depth is None else range(max_depth + 1):
        if robots is not None:
            gated = frontier.withColumn("domain", U.domain(F.col("url"))).join(robots, "domain", "left")
            frontier = gated.where(U.robots_allow(F.col("rules"), agent, F.col("url"))).select("url")
        fetched = checkpointed(stored.join(frontier, "url", "left_semi"))
        level = fetched.select("url", F.lit(depth).alias("depth"))
        visited = level if visited is None else visited.union(level)
        found = links(fetched).select(U.decoded("link").alias("url")).distinct()
        frontier = checkpointed(admissible(found, domains, prefixes).join(visited, "url", "left_anti"))
        if frontier.isEmpty():
            break
    return visited
