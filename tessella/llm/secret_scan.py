"""Secret scans with a trigram inverted index.

Each rule is a regular expression with a Boolean query of trigrams that any
match must hold, derived from the expression's literals: literals in sequence
give conjunctions, alternatives give disjunctions, optional and repeated parts
give nothing.  Documents are indexed by segments (a batch of rows, whole
texts): one pass over a segment's bytes yields the postings of every trigram
that some query names.  A rule's candidates are the intersections and unions of
its postings; only they are verified with the expression itself.  A rule
without mandatory trigrams scans the segment fully.

Segments are independent, as the shards of a search engine are, so nothing is
shuffled and a lost executor costs its own segments only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices


@dataclass(frozen=True)
class Rule:
    """``shortest`` is the least length of ``group``; shorter matches are dropped."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    shortest: int = 0


#: The base rules of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 32),
)
#: Public formats of tokens and keys.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"Authorization:\x20*Bearer\x20+[A-Za-z0-9+/_.=-]{16,}", re.ASCII | re.IGNORECASE),
)
RULES = BASE_RULES + MORE_RULES


# Boolean queries: ("and", parts) | ("or", parts) | a trigram; TRUE matches all.
TRUE: tuple = ("and", ())


def _and(parts: list) -> tuple | str:
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    return flat[0] if len(flat) == 1 else ("and", tuple(dict.fromkeys(flat)))


def _or(parts: list) -> tuple | str:
    return TRUE if TRUE in parts else parts[0] if len(set(parts)) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _strings(tree, limit: int = 16) -> list[str] | None:
    """All strings of a small finite language, lower-cased; else None."""
    sets: list[list[str]] = []
    for op, arg in tree:
        if op is K.LITERAL:
            sets.append([chr(arg).lower()])
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            sets.append(sorted({chr(a).lower() for _, a in arg}))
        elif op is K.SUBPATTERN:
            sets.append(_strings(arg[3], limit))
        elif op is K.BRANCH:
            each = [_strings(b, limit) for b in arg[1]]
            sets.append(None if None in each else sorted({s for e in each for s in e}))
        elif op is K.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            inner = _strings(arg[2], limit)
            sets.append(None if inner is None else ["", *inner])
        else:
            return None
        if sets[-1] is None:
            return None
    out = [""]
    for s in sets:
        out = [a + b for a in out for b in s]
        if len(out) > limit:
            return None
    return out


def trigram_query(pattern: str) -> tuple | str:
    """What trigrams, lower-cased, any match of ``pattern`` holds."""

    def of(tree) -> tuple | str:
        parts, run = [], [""]

        def close() -> None:
            nonlocal run
            parts.append(_or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in run]))
            run = [""]

        for item in tree:
            strings = _strings([item])
            if strings is not None and len(run) * len(strings) <= 64:
                run = [a + b for a in run for b in strings]
                continue
            close()
            op, arg = item
            if strings is not None:
                run = strings
            elif op is K.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is K.BRANCH:
                parts.append(_or([of(b) for b in arg[1]]))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                parts.append(of(arg[2]))
        close()
        return _and([p for p in parts if p != TRUE])

    return of(_parser.parse(pattern))


def _trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class Scanner:
    """Finds the rules' spans in segments of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        named = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = {t: i for i, t in enumerate(named)}
        self.table = np.full(1 << 24, -1, dtype=np.int16)
        for t, i in self.number.items():
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = i
        self.runs = {i: _long_run(r) for i, r in enumerate(rules) if self.queries[i] == TRUE}

    def postings(self, raw: list[bytes], at_once: int = 1 << 22) -> list[np.ndarray]:
        """For each named trigram the sorted numbers of the texts that hold it."""
        found: list[list[np.ndarray]] = [[] for _ in self.number]
        ends = np.cumsum([len(r) + 1 for r in raw])
        flat = np.frombuffer(b"\n".join([r.lower() for r in raw]), dtype=np.uint8)
        for at in range(0, max(0, len(flat) - 2), at_once):
            part = flat[at : at + at_once + 2].astype(np.int32)
            hits = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(hits >= 0)
            pairs = np.unique(hits[where].astype(np.int64) << 40 | np.searchsorted(ends, where + at, side="right"))
            number, text = pairs >> 40, pairs & ((1 << 40) - 1)
            for i in np.unique(number):
                found[i].append(text[number == i])
        return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]

    def candidates(self, query, postings: list[np.ndarray]) -> np.ndarray:
        if isinstance(query, str):
            return postings[self.number[query]]
        lists = sorted((self.candidates(q, postings) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out

    def segment(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """``(start, rule number, end)`` in code points of each text, by start and rule."""
        texts = [t or "" for t in texts]
        raw = [t.encode() for t in texts]
        postings = self.postings(raw)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, (rule, regex, query) in enumerate(zip(self.rules, self.compiled, self.queries)):
            todo = self.candidates(query, postings).tolist() if query != TRUE else self.runs[i](raw)
            for at in todo:
                for m in regex.finditer(texts[at]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.shortest:
                        spans[at].append((m.start(), i, m.end()))
        return [sorted(s) for s in spans]

    def written(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.rules[i].kind}:{start}:{end}" for start, i, end in spans)


def _long_run(rule: Rule):
    """A full scan; for a run of one character class, over its bytes' classes."""
    tree = list(_parser.parse(rule.pattern))
    if len(tree) == 1 and tree[0][0] is K.MAX_REPEAT and rule.group == 0 and rule.shortest > 1 and len(tree[0][1][2]) == 1 and tree[0][1][2][0][0] is K.IN:
        one = re.compile(rule.pattern, rule.flags)
        classes = bytes(1 if b < 128 and one.fullmatch(chr(b)) else 0 for b in range(256))
        needle = b"\x01" * rule.shortest
        return lambda raw: [i for i, r in enumerate(raw) if needle in r.translate(classes)]
    return lambda raw: range(len(raw))


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One scanner for each Python worker."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_rows: int = 2048, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row.

    A null text counts as empty.  Null ids and repeated rows are kept as they
    are; other columns are not carried.  ``spans`` lists ``kind:start:end`` by
    start and rule, in code points; ``rules`` begin with the base rules.
    """
    base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            for part in slices(batch, 1, segment_rows):
                found = scan.segment(part.column(1).to_pylist())
                counts = [pa.array([sum(s[1] == i for s in spans) for spans in found], pa.int64()) for i in range(base)]
                digest = [hashlib.sha256(scan.written([s for s in spans if s[1] < base]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digest, pa.string()), pa.array(map(scan.written, found), pa.string(), size=len(found))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]", segment_rows: int = 2048, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each union of overlapping spans in ``text`` replaced by ``mark``.

    ``n_chars``, where the table has it, is set anew for changed texts.  Null
    texts stay null; all rows and columns stay.
    """
    names = docs.columns
    at_text, at_n = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in batches:
            for part in slices(batch, at_text, segment_rows):
                texts, columns = part.column(at_text).to_pylist(), list(part.columns)
                counts = columns[at_n].to_pylist() if at_n is not None else None
                for i, spans in enumerate(scan.segment(texts)):
                    if spans:
                        texts[i] = _replaced(texts[i], spans, mark)
                        if counts is not None:
                            counts[i] = len(texts[i])
                columns[at_text] = pa.array(texts, columns[at_text].type)
                if counts is not None:
                    columns[at_n] = pa.array(counts, columns[at_n].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done, stop = [], 0, -1
    for start, _, end in spans:
        if start >= stop:
            if stop >= 0:
                out.append(mark)
            out.append(text[max(done, stop) : start])
            done = start
        stop = max(stop, end)
    return "".join([*out, mark, text[stop:]])
