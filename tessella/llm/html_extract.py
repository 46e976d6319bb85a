"""Main text of web pages by template deduction over each host's pages.

Tokens are tags with their path from the root, and runs of text with their
path.  A token's occurrence vector says how often each page of the host holds
it; tokens with one vector form an equivalence class.  A class is valid if it
is large (several tokens) and frequent (on most of the host's pages, on two at
least) and nests: outermost first, a class must lie in one gap between tokens
of the class around it, else it is dropped.  Vectors are compared by a 64-bit
sum of mixed (page, count) pairs, and places by the mean of first and last
positions, so a token needs no more than a few sums, whatever the host's size.
A path is a 64-bit digest of its parent's and its own label, so it has one
size at any depth.

The stretches of a page between the template's tags are its slots.  Text that
is itself template is dropped, and so are slots that hold links for the most
part; what remains in the others is the main text.  Where the page has an
article (or main) element, its slots are those within.  Within an article, text
counts as template only if nearly all of the host's pages (``ARTICLE_SHARE`` of
``ARTICLE_PAGES`` or more) hold it, as copies share text too; a page whose
article is template throughout keeps it.

What the template cannot tell, as such parts vary from page to page as the
article does, is told by elements: menus, footers, sidebars, adverts, notices,
forms and reader comments, by tag or by a class, id or role made of nothing
but such words.  An element that holds the page's main article is never one,
nor is a form or header that holds most of the page's text, nor a header
within an article.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .shared import materialise, slices

_PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|[^<]+|<""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
_CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Elements and names whose content isn't the article's.
_ASIDE_TAGS = frozenset("nav header footer aside form menu dialog select button head fieldset".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget widgets related recommended recommendations popular trending share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus respond reply replies discussion pagination pager toolbar complementary contentinfo banner".split()
)
#: Words that may stand beside them in a name.
_PLAIN_WORDS = frozenset(
    "site page global main primary secondary left right top bottom upper lower inner outer box block wrap wrapper container section area region bar panel list item items links link row col column the post posts entry article user reader text image slot unit buttons button icons group zone form field input title heading content body policy message by more all sticky fixed mobile desktop js".split()
)
#: As an id alone these are anchors of an article's own sections.
_ANCHOR_WORDS = frozenset("related discussion popular trending recommended recommendations search share sharing social promotion notice notices alert reply replies respond".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Pages of a host from which its template decides within articles too, and the share of them.
ARTICLE_PAGES = 8
ARTICLE_SHARE = 0.9
#: The token that every page of a host has: it counts the pages.
_EVERY_PAGE = 0


@dataclass
class Run:
    """A block of text: its pieces, its token, its slot, and the aside and article elements around it."""

    pieces: list[str]
    path: int
    slot: int
    within: tuple[int, ...]
    linked: int = 0
    aside: bool = False
    article: bool = False
    words: str | None = None

    def text(self) -> str:
        if self.words is None:
            self.words = " ".join(html.unescape("".join(self.pieces)).split())
        return self.words


@dataclass
class _Open:
    tag: str
    path: int
    within: tuple[int, ...]


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)


_ASIDE, _FORM, _HEADER, _ARTICLE, _COMMENT = "aside", "form", "header", "article", "comment"


def _all_aside(name: str, words: frozenset[str]) -> bool:
    parts = [w.lower() for w in _NAME_PART.findall(name)]
    return any(w in words for w in parts) and all(w in words or w in _PLAIN_WORDS for w in parts)


@functools.lru_cache(maxsize=20_000)
def _label(tag: str, attributes: str) -> tuple[str, str | None]:
    """The tag with its names, and what kind of element it opens, if any."""
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)] if "=" in attributes else []
    label = f"{tag}[{' '.join(map(':'.join, found))}]" if found else tag
    names = [(kind, n) for kind, value in found for n in value.split()]
    if tag in ("html", "body"):
        return label, None
    if any(_all_aside(n, _COMMENT_WORDS if kind != "id" else _COMMENT_WORDS - _ANCHOR_WORDS) for kind, n in names):
        return label, _COMMENT
    if tag in ("article", "main") or ("role", "main") in names:
        return label, _ARTICLE
    if tag in ("form", "fieldset", "header"):
        return label, _HEADER if tag == "header" else _FORM
    if tag in _ASIDE_TAGS:
        return label, _ASIDE
    if tag[0] == "h" and tag[1:].isdigit():
        return label, None
    for kind, n in names:
        if _all_aside(n, _ASIDE_WORDS if kind != "id" else _ASIDE_WORDS - _ANCHOR_WORDS):
            parts = {w.lower() for w in _NAME_PART.findall(n)}
            return label, _HEADER if "header" in parts else _ASIDE
    return label, None


def read_page(source: str) -> Page:
    """The tokens and text runs of a page, in page order."""
    page = Page()
    stack = [_Open("", _EVERY_PAGE, ())]
    opened: dict[str, int] = {}
    kinds: list[str] = []
    run: Run | None = None

    def close_until(position: int) -> None:
        for gone in reversed(stack[position:]):
            page.tokens.append(_token(gone.path, "/"))
            opened[gone.tag] -= 1
        del stack[position:]

    for piece in _PIECE.finditer(source):
        tag = piece[3]
        if tag is None:
            if piece[1] is not None:
                if piece[1].lower() in ("textarea", "title", "svg"):
                    run = None
            elif not piece[0].startswith(("<!", "<?")):
                if run is None:
                    run = Run([], stack[-1].path, len(page.tokens), stack[-1].within)
                    page.runs.append(run)
                run.pieces.append(piece[0])
                if opened.get("a"):
                    run.linked += len(piece[0].strip())
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            run = None
        if tag == "br" and run is not None:
            run.pieces.append(" ")
        if piece[2]:
            if opened.get(tag):
                close_until(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        label, kind = _label(tag, piece[4])
        if tag in _CLOSES_SAME or tag in _CLOSES_P and opened.get("p"):
            limits = _CLOSES_SAME.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if limits is None and open_tag == "p" or limits is not None and (open_tag == tag or {open_tag, tag} in ({"dd", "dt"}, {"td", "th"})):
                    close_until(i)
                    break
                if open_tag in (limits or _BLOCKS):
                    break
        top = stack[-1]
        path = _token(top.path, label)
        page.tokens.append(path)
        if tag not in _VOID and not piece[4].endswith("/") or tag == "a":
            within = top.within
            if kind is not None:
                within = (*within, len(kinds))
                kinds.append(kind)
            stack.append(_Open(tag, path, within))
            opened[tag] = opened.get(tag, 0) + 1
    close_until(1)
    page.runs = [r for r in page.runs if not "".join(r.pieces).isspace()]
    _set_places(page.runs, kinds)
    return page


def _set_places(runs: list[Run], kinds: list[str]) -> None:
    """Which runs are beside the article and which are within one."""
    if not kinds:
        return
    sizes = [0] * len(kinds)
    total = 0
    for r in runs:
        n = sum(map(len, r.pieces)) - r.linked
        total += n
        for k in r.within:
            sizes[k] += n
    around: dict[int, tuple[int, ...]] = {}
    for r in runs:
        for i, k in enumerate(r.within):
            around.setdefault(k, r.within[:i])
    clear = lambda k: not any(kinds[o] == _COMMENT for o in around[k])
    articles = [k for k in around if kinds[k] == _ARTICLE and clear(k)]
    open_ones = [k for k in articles if not any(kinds[o] == _ASIDE for o in around[k])]
    best = max(open_ones or articles, key=lambda k: (sizes[k], -k), default=None)
    held = {best, *around[best]} if best is not None else set()
    inside = set(articles)
    whole = {k for k in around if kinds[k] in (_FORM, _HEADER) and best is None and 2 * sizes[k] > total}
    headed = {k for k in around if kinds[k] == _HEADER and any(o in inside for o in around[k])}
    beside = {k for k in around if kinds[k] != _ARTICLE} - held - whole - headed
    for r in runs:
        r.aside = any(k in beside for k in r.within)
        r.article = any(k in inside for k in r.within)


@functools.lru_cache(maxsize=200_000)
def _token(path: int, label: str) -> int:
    """The digest of a label under a path."""
    return _hash(f"{path}/{label}")


def _hash(token: str) -> int:
    return struct.unpack("<q", hashlib.blake2b(token.encode(), digest_size=8).digest())[0]


def _mix(page: int, count: int) -> int:
    """A 64-bit mix of a page and a count, for sums that stand for vectors."""
    z = (page + count * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return z ^ z >> 31


def _signed(value: int) -> int:
    value &= 0xFFFFFFFFFFFFFFFF
    return value - (1 << 64) if value >> 63 else value


def host_column(url: str) -> Column:
    """The host of a URL, lower-cased; null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def page_tokens(page: Page) -> list[tuple[int, float]]:
    """Tokens with their place from 0 to 1; runs of text follow the tags."""
    n = max(1, len(page.tokens))
    return [(t, i / n) for i, t in enumerate(page.tokens)] + [(_text_token(r), (r.slot - 0.5) / n) for r in page.runs]


def _text_token(run: Run) -> int:
    return _hash(f"{run.path}#{run.text()}")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors by host of the tokens of slices of bounded text."""
    for batch in (part for whole in batches for part in slices(whole, 2, 10_000, 32_000_000)):
        sums: dict[tuple[str, int], list] = {}
        for host, url, source in zip(*(c.to_pylist() for c in batch.columns)):
            number = _hash(f"{url}\n{source}") & 0xFFFFFFFFFFFFFFFF
            found: dict[int, list] = {_EVERY_PAGE: [1, 0.0, 0.0]}  # on every page: counts pages
            for token, place in page_tokens(read_page(source or "")):
                seen = found.setdefault(token, [0, place, place])
                seen[0] += 1
                seen[2] = place
            for token, (n, first, last) in found.items():
                s = sums.setdefault((host, token), [0, 0, 0, 0.0, 0.0])
                for i, v in enumerate((_mix(number, n), 1, n, first, last)):
                    s[i] += v
        keys, values = list(sums), list(zip(*sums.values())) if sums else [()] * 5
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(map(_signed, values[0]), pa.int64(), size=len(keys))]
        columns += [pa.array(v, t) for v, t in zip(values[1:], (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "vector", "pages", "total", "first", "last"])


def nested(classes: list[list[tuple[float, float, int]]]) -> list[int]:
    """The tokens of the classes ``[(first, last, token)]`` that nest, outermost first."""
    ordered = sorted((sorted(c) for c in classes), key=lambda c: (min(t[0] for t in c) - max(t[1] for t in c), c))
    kept: list[list[tuple[float, float, int]]] = []
    for c in ordered:
        low, high = min(t[0] for t in c), max(t[1] for t in c)
        around = [k for k in kept if k[0][0] <= low and high <= max(t[1] for t in k)]
        # In the innermost class around it, no token may stand amid this class's own.
        if not around or not any(low < first < high or low < last < high for first, last, _ in around[-1]):
            kept.append(c)
    return [t for c in kept for _, _, t in c]


@F.pandas_udf(ArrayType(LongType()))
def _nested(classes: pd.Series) -> pd.Series:
    return classes.map(lambda host: nested([[(t["first"], t["last"], t["token"]) for t in c["members"]] for c in host]))


def templates(pages: DataFrame, url: str = "url", source: str = "html", least_tokens: int = 2, least_share: float = 0.5) -> DataFrame:
    """``(host, tokens array<long>, firm array<long>)``: the tokens of each host's valid classes.

    ``firm`` are those that count within articles.
    """
    known = pages.select(host_column(url).alias("host"), F.col(url).alias("url"), F.col(source).alias("html")).where("host is not null")
    parts = known.mapInArrow(_vectors, "host string, token long, vector long, pages long, total long, first double, last double")
    # Sums wrap around: each half of a vector is summed apart, so none overflows.
    halves = parts.withColumns({"hi": F.shiftrightunsigned("vector", 32), "lo": F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))})
    token = halves.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("hi", "lo", "pages", "total", "first", "last")])
    token = materialise(token.where("pages > 1"), "tokens")
    sizes = token.where(F.col("token") == _EVERY_PAGE).select("host", F.col("pages").alias("of"))
    frequent = token.where(F.col("token") != _EVERY_PAGE).join(sizes, "host").where(F.col("pages") >= F.greatest(F.lit(2.0), F.lit(least_share) * F.col("of")))
    place = F.struct(F.round(F.col("first") / F.col("pages"), 9).alias("first"), F.round(F.col("last") / F.col("pages"), 9).alias("last"), "token")
    firm = (F.col("of") >= ARTICLE_PAGES) & (F.col("pages") >= F.lit(ARTICLE_SHARE) * F.col("of"))
    classes = frequent.groupBy("host", "of", "hi", "lo", "pages", "total").agg(F.array_sort(F.collect_list(place)).alias("members")).withColumn("firm", firm)
    # At most as many tokens a host as twice those of a page: each is on half of the pages.
    valid = classes.where(F.size("members") >= least_tokens)
    hosts = valid.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("members", "firm"))).alias("classes"))
    tokens = hosts.select("host", _nested("classes").alias("tokens"), F.flatten(F.transform(F.filter("classes", lambda c: c["firm"]), lambda c: c["members"]["token"])).alias("firm"))
    return tokens.select("host", "tokens", F.array_intersect("tokens", "firm").alias("firm"))


def extract(page: Page, template: frozenset[int] | set[int] = frozenset(), firm: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page under its host's template."""
    # Slots: the stretches between template tokens.
    slot_of, slot = [0], 0
    for token in page.tokens:
        slot += token in template
        slot_of.append(slot)
    slots: dict[int, list[Run]] = {}
    for r in page.runs:
        slots.setdefault(slot_of[r.slot], []).append(r)
    article = any(r.article and not r.aside for r in page.runs)
    drop = firm if article else template
    own = {id(r) for r in page.runs if not drop or _text_token(r) not in drop}
    if article and not any(id(r) in own for r in page.runs if r.article and not r.aside):
        own = {id(r) for r in page.runs}
    blocks = []
    for runs in slots.values():
        chosen = [r for r in runs if not r.aside and id(r) in own and (r.article or not article)]
        if not article:
            size = sum(len("".join(r.pieces)) for r in chosen)
            if size and sum(r.linked for r in chosen) > 0.5 * size:
                chosen = []
        blocks += [t for r in chosen if (t := r.text())]
    return "\n".join(blocks)


#: Templates are broadcast while their measured size is below this; else joined by host.
BROADCAST_TOKENS = 2_000_000


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    A null html counts as empty and gives an empty text.  A page without a host
    (null or broken url) and the only page of a host have no template; their
    slots are the elements alone.  Repeated rows, null ids and empty tables
    give what they hold; other columns are not carried.
    """
    found = materialise(templates(pages, url, source), "templates")
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    joined = rows.withColumn("host", host_column("url")).join(F.broadcast(found) if size <= BROADCAST_TOKENS else found, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for whole in batches:
            for batch in slices(whole, 2):
                texts = []
                for page_source, *lists in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                    key = tuple(tuple(tokens or ()) for tokens in lists)
                    if key not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[key] = tuple(map(frozenset, key))
                    texts.append(extract(read_page(page_source or ""), *known[key]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "tokens", "firm").mapInArrow(run, "page_id long, url string, text string, n_chars long")
