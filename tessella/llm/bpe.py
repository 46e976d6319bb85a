r"""Byte-level BPE as a monoid: encode halves, join them at their boundary.

An element is the token sequence of a piece of text as if the piece stood
alone.  The join of two neighbours re-encodes a window around their boundary.
The window grows on each side until it ends at a place where the pre-tokenizer
must split whatever surrounds it; tokens outside are then proved stable:

* no alternative of the split pattern has white space after other characters,
  so a match ends wherever white space follows a non-space character;
* the pattern looks behind nothing, so what follows such a place is split as
  if the text began there; its only look-ahead, ``\s+(?!\S)``, is for matches
  that end in white space, so what precedes is split as if the text ended there;
* merges never cross a match.

A side without such a place is re-encoded whole.  The operation is associative,
so the tree's shape does not matter.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

LEAF_CHARS = 1024
#: The characters of Unicode's White_Space, which the pattern's ``\\s`` means.
WHITE_SPACE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
FIRST_WINDOW = 32


class TreeBpe:
    """Encoder and decoder for a file of ranks and a split pattern."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf_chars = leaf_chars
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal_of = [str(i) for i in range(len(self.bytes_of))]
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str, start: int = 0, stop: int | None = None) -> list[int]:
        """The ids of ``text[start:stop]``."""
        stop = len(text) if stop is None else stop
        if stop - start <= self.leaf_chars:
            return self.leaf(text[start:stop])
        middle = (start + stop) // 2
        left, right = self.encode(text, start, middle), self.encode(text, middle, stop)
        return self.join(text, start, middle, stop, left, right)

    def join(self, text: str, start: int, middle: int, stop: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of ``text[start:stop]`` from those of its parts about ``middle``."""
        if _splits_at(text, middle):
            return left + right
        width = FIRST_WINDOW
        while (first := _last_split(text, max(start, middle - width), middle)) is None and middle - width > start:
            width *= 2
        first = start if first is None else first
        width = FIRST_WINDOW
        while (last := _first_split(text, middle, min(stop, middle + width))) is None and middle + width < stop:
            width *= 2
        last = stop if last is None else last
        keep = self._cut_back(left, len(text[first:middle].encode()))
        skip = self._cut_front(right, len(text[middle:last].encode()))
        return left[:keep] + self.leaf(text[first:last]) + right[skip:]

    def _cut_back(self, ids: list[int], n_bytes: int) -> int:
        at = len(ids)
        while n_bytes > 0:
            at -= 1
            n_bytes -= len(self.bytes_of[ids[at]])
        return at

    def _cut_front(self, ids: list[int], n_bytes: int) -> int:
        at = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[at]])
            at += 1
        return at

    def decode(self, ids: list[int], start: int = 0, stop: int | None = None) -> bytes:
        """The bytes of ``ids[start:stop]``."""
        stop = len(ids) if stop is None else stop
        if stop - start <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids[start:stop]))
        middle = (start + stop) // 2
        return self.decode(ids, start, middle) + self.decode(ids, middle, stop)


def _splits_at(text: str, at: int) -> bool:
    return text[at] in WHITE_SPACE and text[at - 1] not in WHITE_SPACE


def _last_split(text: str, low: int, high: int) -> int | None:
    return next((i for i in range(high - 1, low, -1) if _splits_at(text, i)), None)


def _first_split(text: str, low: int, high: int) -> int | None:
    return next((i for i in range(low + 1, high) if _splits_at(text, i)), None)


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeBpe:
    """One codec for each Python worker."""
    return TreeBpe(ranks_path, pattern, leaf_chars)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    With ``keep_ids`` also ``token_ids array<int>``.  A null text counts as
    empty: no tokens, and the digests of the empty string.  Columns of ``docs``
    with the names of new ones are replaced.  Every row gives one row, repeated
    rows too; an empty table gives an empty one.  The vocabulary file must be at
    ``ranks_path`` on every executor.
    """
    new = {"token_ids": "array<int>"} if keep_ids else {}
    new |= {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    source = docs.select(F.col(text).alias("__text"), *[F.col(c) for c in docs.columns if c != text and c not in new])
    kept = source.columns[1:]
    schema = source.drop("__text").withColumns({c: F.lit(None).cast(t) for c, t in new.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole, 0, 1024, 2_000_000):
                ids, sizes, encoded, decoded = [], [], [], []
                for t in batch.column(0).to_pylist():
                    own = bpe.encode(t or "")  # as Python numbers, one text's at a time
                    sizes.append(len(own))
                    encoded.append(hashlib.sha256(" ".join(map(bpe.decimal_of.__getitem__, own)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                    if keep_ids:
                        ids.append(np.array(own, dtype=np.int32))
                digests = [pa.array(sizes, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    digests.insert(0, pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *digests], names=[*kept, *new])

    return source.mapInArrow(run, schema)
