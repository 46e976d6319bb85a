"""Line-first quality rules.

Every line with words is judged alone by punctuation, navigation and
boilerplate rules; lines that fail are removed; a document that loses too large
a part of its words' bytes is rejected.  Statistics of the whole document give
a base verdict that the lines cannot overrule.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = _SYMBOLS.encode()
#: A mark that ends a sentence: before a space or the line's end, or one that other scripts write without a space.
SENTENCE_END = r"""[.!?][\"'”’»)\]]*(?:\s|$)|[…。！？।॥؟۔։።]"""
_SENTENCE_END = re.compile(SENTENCE_END)
#: Letters of scripts that end sentences by spaces or marks of their own.
UNMARKED = "[฀-࿿က-႟ក-៿]"
_UNMARKED = re.compile(UNMARKED)
_SEPARATORS = {b"|", "»".encode(), "›".encode(), "•".encode(), "·".encode(), b">", b"/"}
#: Phrases of lines that pages carry around their text; they are boilerplate in lines of up to twice their words.
BOILERPLATE = (
    "advertisement",
    "newsletter",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "follow us",
    "log in",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share on",
    "sign in",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
    "all rights reserved",
)
#: And openings of longer ones.
BOILERPLATE_OPENINGS = (
    r"(?:this|our) (?:web)?site uses cookies\b",
    r"we use cookies\b",
    r"by (?:using|continuing to use) (?:this|our) (?:web)?site\b",
    r"(?:click|tap) here to\b",
    r"(?:please )?(?:sign|log) in to (?:continue|comment|post|reply)\b",
    r"subscribe to our\b",
    r"follow us on\b",
    r"share this (?:article|page|post|story)? ?on\b",
    r"(?:please )?enable javascript\b",
)
BOILERPLATE_END = "all rights reserved"
BOILERPLATE_BY_WORDS = {n: r"\b(?:" + "|".join(p for p in BOILERPLATE if len(p.split()) == n) + r")\b" for n in sorted({len(p.split()) for p in BOILERPLATE})}
_BY_WORDS = [(2 * n, re.compile(p.encode())) for n, p in BOILERPLATE_BY_WORDS.items()]
_OPENING = re.compile("|".join(BOILERPLATE_OPENINGS).encode())


@dataclass(frozen=True)
class LineRules:
    """Shares are of a line's words unless named otherwise."""

    separators: float = 0.2
    symbol_words: float = 0.3
    repeats: float = 0.3
    capitals: float = 0.7  # of its cased ASCII letters
    least_words: int = 5  # for repeats, capitals and punctuation
    boilerplate_words: int = 40  # longer lines aren't boilerplate
    lost: float = 0.5  # of a document's bytes in words
    fail_short: bool = True  # texts of fewer than 50 words; else their lines alone decide, if they have any


def line_fails(line: bytes, words: list[bytes], rules: LineRules = LineRules()) -> str | None:
    """The name of the first rule that a line with words fails, or None."""
    n = len(words)
    if n >= 2 and sum(w in _SEPARATORS for w in words) >= max(2, rules.separators * n):
        return "navigation"
    if n <= rules.boilerplate_words and _boilerplate(b" ".join(words).lower(), n):
        return "boilerplate"
    if len(line) - len(line.translate(None, _SYMBOL_BYTES)) >= rules.symbol_words * n and sum(len(w) != len(w.translate(None, _SYMBOL_BYTES)) for w in words) >= max(3, rules.symbol_words * n):
        return "symbols"
    if n < rules.least_words:
        return None
    if sum(map(eq, words, words[1:])) >= rules.repeats * n:
        return "repeats"
    if _capitals(line) >= rules.capitals:
        return "capitals"
    text = line.decode()
    return None if _SENTENCE_END.search(text) or _UNMARKED.search(text) else "punctuation"


def _boilerplate(line: bytes, n: int) -> bool:
    return _OPENING.match(line) is not None or line.rstrip(b".").endswith(BOILERPLATE_END.encode()) or any(n <= most and phrase.search(line) for most, phrase in _BY_WORDS)


def _capitals(line: bytes) -> float:
    upper = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    cased = upper + len(line) - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper / cased if cased else 0.0


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, free = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(i, free)
            free = i + 3
    return total


def measure(text: str | None, rules: LineRules = LineRules()) -> dict:
    """All figures and verdicts of one text (null: none), and ``cleaned``: its bytes without failing lines."""
    text = text or ""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, _SPACE))
    seen: set[bytes] = set()
    duplicates = total = lost = 0
    left: list[bytes] = []
    for line in text.encode().split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        size = sum(map(len, own))
        total += size
        if line_fails(line, own, rules):
            lost += size
        else:
            left.append(line)
    repeated = repeat_words(words)
    base_failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    passes = not base_failed or not rules.fail_short and 0 < len(words) < 50
    return {
        "n_words": len(words),
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "kept": passes and lost <= rules.lost * total,
        "lost_share": lost / total if total else 0.0,
        "cleaned": b"\n".join(left),
    }


_TYPES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "lost_share": "double", "cleaned_chars": "long", "cleaned_sha256": "string"}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def _figures(text: str | None, rules: LineRules) -> dict:
    found = measure(text, rules)
    cleaned = found.pop("cleaned")
    return found | {"cleaned_chars": len(cleaned.decode()), "cleaned_sha256": hashlib.sha256(cleaned).hexdigest()}


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_share, cleaned_chars, cleaned_sha256)``.

    The last two are code points and digest (of the UTF-8) of the text without
    its failing lines.  A null text has no words, fails and is cleaned as an empty one.  Null ids and repeated rows stay; other
    columns are not carried; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [_figures(t, rules) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[c] for r in rows], _ARROW[t]) for c, t in _TYPES.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_TYPES])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in _TYPES.items()))


def keep_good(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            yield batch.filter(pa.array([measure(t, rules)["kept"] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cleaned(text: str | None, rules: LineRules = LineRules()) -> str | None:
    """A text without its failing lines (null stays null)."""
    if text is None:
        return None
    return measure(text, rules)["cleaned"].decode()


def keep_cleaned(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, without its failing lines.

    Verdicts are those of the whole text.  ``n_chars``, where the table has it,
    is set anew for changed texts; the other columns stay as they are.
    """
    names = docs.columns
    at, at_n = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (part for batch in batches for part in slices(batch, at)):
            texts = whole.column(at).to_pylist()
            found = [measure(t, rules) for t in texts]
            batch = whole.filter(pa.array([m["kept"] for m in found], pa.bool_()))
            changed = [m["cleaned"].decode() if m["lost_share"] else None for m in found if m["kept"]]
            columns = list(batch.columns)
            columns[at] = pa.array([t if c is None else c for t, c in zip(columns[at].to_pylist(), changed)], columns[at].type)
            if at_n is not None:
                columns[at_n] = pa.array([n if c is None else len(c) for n, c in zip(columns[at_n].to_pylist(), changed)], columns[at_n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with the failing lines removed from ``text`` (null stays null)."""
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([cleaned(t, rules) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
