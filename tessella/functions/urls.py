"""URL functions; percent-decoding and joining follow Python's library."""

from __future__ import annotations

from urllib import robotparser
from urllib.parse import quote, unquote, urldefrag, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tessella import vocab


def normal_url(url: str) -> str:
    parts = urlsplit(unquote(url))
    return urlunsplit((parts.scheme, parts.netloc, quote(parts.path.split(";")[0] if ";" in parts.path.rsplit("/", 1)[-1] else parts.path, safe="/"), parts.query, "")).rstrip("?")


@F.pandas_udf(StringType())
def normalized(url: pd.Series) -> pd.Series:
    """Decoded, the path quoted anew, the query as it is, no parameters or fragment."""
    return url.map(lambda u: None if u is None else normal_url(u))


@F.pandas_udf(StringType())
def decoded(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else unquote(u))


@F.pandas_udf(StringType())
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """The absolute URL of a link without its fragment; null unless http(s)."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            full = urldefrag(urljoin(b or "", x or "")).url
        except ValueError:
            return None
        return full if full.startswith(("http://", "https://")) else None

    return pd.Series([one(b, x) for b, x in zip(base, link)])


def domain(url: Column) -> Column:
    """Host and port, as the URL gives them."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_html(url: Column, suffixes: list[str] = vocab.NOT_HTML) -> Column:
    return ~F.lower(path(url)).rlike(r"\.(?:" + "|".join(suffixes) + r")$")


def robots_allow(rules: Column, agent: str, url: Column) -> Column:
    """Whether the text of a robots file lets ``agent`` fetch; a missing file forbids."""

    @F.pandas_udf(BooleanType())
    def check(texts: pd.Series, urls: pd.Series) -> pd.Series:
        known: dict[str | None, robotparser.RobotFileParser] = {}
        out = []
        for text, one in zip(texts, urls):
            if text not in known:
                known[text] = robotparser.RobotFileParser()
                if text is not None:
                    known[text].parse(text.splitlines())
            out.append(bool(one) and known[text].can_fetch(agent, one))
        return pd.Series(out, dtype=bool)

    return check(rules, url)
