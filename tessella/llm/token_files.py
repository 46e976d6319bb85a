"""Token sequences as length-delimited binary records with an offset index.

A shard ``NNNNN-attempt.rec`` is a series of records, all integers little-endian::

    u64 length | u32 masked crc32 of the length's 8 bytes | payload | u32 masked crc32 of the payload

A mask rotates the checksum right by 15 bits and adds 0xa282ead8 modulo 2**32,
so that checksums of data that hold checksums stay sound.  The payload is::

    i64 doc_id | u8 1 if doc_id is null | u8 bytes a token (2 or 4) | ids

``NNNNN-attempt.idx`` holds, for each record, u64 offset in the shard | u64 number of
tokens before it in the shard: a reader that shuffles seeks straight to a record.

Shards follow ascending doc_id: documents are range-partitioned and sorted,
then encoded and framed in the same task.  Each attempt of a task writes files
of its own name; the manifest, which Spark commits, names those of the attempt
that counts, so retried or doubled tasks never touch a file that is read.
Folders are opened with pyarrow's filesystems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import new_path, slices

_HEAD, _META, _INDEX, _CRC = struct.Struct("<QI"), struct.Struct("<qBB"), struct.Struct("<QQ"), struct.Struct("<I")
#: Words whose ids a worker remembers at most; it forgets all beyond them.
MEMORY_WORDS = 1_000_000
#: Bytes of text that a shard holds about, if there are more than the session's partitions can.
SHARD_BYTES = 128_000_000
_JOINED_SPACE = re.compile(r"\s | \s")
#: Latin words with a space or line end before and marks after: pieces that the pre-tokenizer separates so.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class WordMemoEncoder:
    """The ids of whole texts by the ``tokenizers`` library.

    The pre-tokenizer of this family (byte level, with its usual pattern) splits
    wherever white space follows another character.  Words cut at spaces and
    line ends are encoded once and remembered.  Texts with other runs of white
    space are cut at single spaces only; those with a space in such a run go to
    the library whole.  A Latin word, a space before it and marks after it are
    what the pattern splits off themselves: such words go to the library's
    model, the others through its pre-tokenizer, many in a call.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        added = self.tokenizer.get_added_tokens_decoder()
        # In a byte-level vocabulary each character of a token stands for a byte.
        self.n_bytes = np.array([len(added[i].content.encode()) if i in added else len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.packed = [i.to_bytes(self.width, "little") for i in range(size)]
        # Printable bytes of Latin-1 stand for themselves; the others, in order, for what follows it.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
        self.memo: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str], at_once: int = 500_000) -> list[bytes]:
        """The ids of each text, packed."""
        if len(self.memo) + len(self.bare) > MEMORY_WORDS:
            self.memo.clear()
            self.bare.clear()
        simple = [bool(t) and not t[0].isspace() and "\x00" not in t for t in texts]
        rows = pa.array([t if s else "" for t, s in zip(texts, simple)], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(rows, "\n", "\x00\n"), " ", "\x00 "), "\x00")
        words = cut.values.dictionary_encode()
        of_word, distinct = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, distinct))
        fresh = [k for k, i in enumerate(ids) if i is None]
        self._learn({distinct[k] for k in fresh if distinct[k]})
        runs = np.zeros(len(ids), dtype=bool)
        for k in fresh:
            # A word that ends in white space isn't remembered: a run goes on behind it.
            found = self.memo.get(distinct[k])
            runs[k] = found is None and distinct[k] != ""
            ids[k] = found or b""
        tokens = np.frombuffer(b"".join(ids), dtype=self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[of_word])])
        flat = np.empty(int(ends[-1]), dtype=self.dtype)
        for i in range(0, len(of_word), at_once):
            some = of_word[i : i + at_once]
            lens = sizes[some]
            at = np.repeat(starts[some] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            flat[ends[i] : ends[i] + len(at)] = tokens[at]
        bounds = cut.offsets.to_numpy()
        broken = np.concatenate([[0], np.cumsum(runs[of_word])])[bounds]
        at = (ends[bounds] * self.width).tolist()
        packed = flat.tobytes()
        whole = (np.diff(broken) == 0) & np.array(simple, dtype=bool)
        return [packed[i:j] if w else self._with_runs(t) for t, w, i, j in zip(texts, whole.tolist(), at, at[1:])]

    def _with_runs(self, text: str) -> bytes:
        """The ids of a text with other white space than single spaces and line ends."""
        if not text or text[0].isspace() or "\x00" in text or _JOINED_SPACE.search(text):
            return self.whole(text) if text else b""
        words = text.replace(" ", "\x00 ").split("\x00")
        self._learn({w for w in words if w not in self.memo})
        return b"".join([self.memo[w] if w in self.memo else self.whole(w) for w in words])

    def _learn(self, words: set[str], at_once: int = 2_000) -> None:
        rest = []
        memo, bare, piece = self.memo, self.bare, self._piece
        for w in words:
            stem = w.rstrip(_MARKS)
            before = stem[:1]
            letters = stem[1:] if before in (" ", "\n") else stem
            if letters.isalpha() and (letters.isascii() or _LATIN.fullmatch(letters)):
                if before == "\n":
                    ids = (bare.get(before) or piece(before)) + (bare.get(letters) or piece(letters))
                else:
                    ids = bare.get(stem) or piece(stem)
                marks = w[len(stem) :]
                memo[w] = ids + (bare.get(marks) or piece(marks)) if marks else ids
            elif w[-1].isspace():
                continue
            elif w[0] in " \n":
                rest.append(w)
            else:
                memo[w] = self.whole(w)
        for i in range(0, len(rest), at_once):
            some = rest[i : i + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.int64)
            sizes = np.fromiter(map(len, map(str.encode, some)), np.int64, len(some))
            stops = ((np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1) * self.width).tolist()
            packed = ids.astype(self.dtype).tobytes()
            self.memo.update(zip(some, map(packed.__getitem__, map(slice, [0, *stops], stops))))

    def _piece(self, piece: str) -> bytes:
        """The ids of what the pre-tokenizer takes as one piece."""
        coded = piece if piece.isascii() and piece.isalpha() else "".join(map(self.letters.__getitem__, piece.encode()))
        packed = self.bare[piece] = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(coded)])
        return packed


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_path: str) -> WordMemoEncoder:
    return WordMemoEncoder(tokenizer_path)


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return head + _CRC.pack(mask(zlib.crc32(head))) + payload + _CRC.pack(mask(zlib.crc32(payload)))


def _payload(doc_id: int | None, width: int, packed: bytes) -> bytes:
    return _META.pack(doc_id or 0, doc_id is None, width) + packed


def _index_entry(offset: int, n_tokens: int) -> bytes:
    return _INDEX.pack(offset, n_tokens)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system that Spark takes it to be in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", found).rstrip("/")


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder:
        raise ValueError(f"{folder}: a folder needs a scheme, as executors and driver may take it differently")
    return pafs.FileSystem.from_uri(folder)


def _writer(folder: str, tokenizer_path: str, end_id: int, part_rows: int = 4096, part_bytes: int = 8_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder = _encoder(tokenizer_path)
        tail = np.array([end_id], dtype=encoder.dtype).tobytes()
        fs, root = _open(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:05d}-{uuid.uuid4().hex}"
        fs.create_dir(root, recursive=True)
        n_docs = n_tokens = offset = 0
        with fs.open_output_stream(f"{root}/{name}.rec") as rec, fs.open_output_stream(f"{root}/{name}.idx") as idx:
            for batch in itertools.chain([first], batches):
                for part in slices(batch, 1, part_rows, part_bytes):
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc_id, packed in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                        record = frame(_payload(doc_id, encoder.width, packed + tail))
                        rec.write(record)
                        idx.write(_index_entry(offset, n_tokens))
                        offset += len(record)
                        n_tokens += len(packed) // encoder.width + 1
                        n_docs += 1
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to ``folder``; returns the manifest ``(shard, name, n_docs, n_tokens, start)``.

    ``start`` counts the tokens of all shards before.  Null texts are empty (a
    record of the end id alone), null ids come first, rows with equal ids stand
    in the order of their texts; such rows are dealt to several shards by the
    first characters of their texts.  Other columns are not written.  An empty
    table gives an empty manifest.  The number of shards follows the size of
    the texts, and is no less than the session's shuffle partitions.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = source.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    path = f"{folder}/manifest"
    dealt.mapInArrow(_writer(f"{folder}/shards", tokenizer_path, end_id), "shard long, name string, n_docs long, n_tokens long").write.parquet(path)
    manifest = spark.read.parquet(path)  # a row for each shard
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shard(folder: str, name: str, order: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray, int]]:
    """``(doc_id, ids, tokens before it in the shard)`` of each record, in ``order`` if given.

    Both checksums of each record are verified.
    """
    fs, root = _open(folder)
    with fs.open_input_stream(f"{root}/shards/{name}.idx") as f:
        index = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
    with fs.open_input_file(f"{root}/shards/{name}.rec") as f:
        for i in range(len(index)) if order is None else order:
            f.seek(int(index[i, 0]))
            length, crc = _HEAD.unpack(head := f.read(_HEAD.size))
            if mask(zlib.crc32(head[:8])) != crc:
                raise ValueError(f"{root}/{name}.rec: record {i} has a broken length")
            payload = f.read(length)
            if mask(zlib.crc32(payload)) != _CRC.unpack(f.read(4))[0]:
                raise ValueError(f"{root}/{name}.rec: record {i} is broken")
            doc_id, null, width = _META.unpack_from(payload)
            yield None if null else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=_META.size), int(index[i, 1])


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record of the files."""
    spark = manifest.sparkSession
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids, before in read_shard(folder, name):
                    rows.append((doc_id, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.select("name", "start").repartition(max(n, manifest.count() // 8), "name")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return new_path(spark, "tokens")
