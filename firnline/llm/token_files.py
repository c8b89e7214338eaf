"""Token ids as Arrow files of equal-length sequences.

Documents are placed by range of ``doc_id``; every task encodes its range in order and
writes one shard: an Arrow file whose record batches hold ``ids`` and ``mask`` as
fixed-size lists, so that sequence ``i`` is a slice of a mapped buffer. Documents follow
each other without gaps, each closed by the end id; only the last sequence of a shard is
padded, and its mask says where. A second small file lists the documents of the shard.

A shard gets a new name in every attempt and counts only once the manifest, a table that
Spark commits, names it. A repeated or lost task therefore leaves at most a file that
nothing refers to.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.columns import read_table, text_or_empty
from firnline.llm.shared_files import create, new_folder, open_mapped
from firnline.llm.token_counts import PRE_TOKEN, SPACE, added_tokens, vocabulary_path

QUERY = "op9_token_files"

LENGTH = 2048
END_ID = 0
#: Pre-tokens that are encoded as one text.
JOINED = 256
_MANIFEST = "shard int, file string, n_sequences bigint, n_tokens bigint, n_docs bigint"


def _ranges(kind: str) -> str:
    """Body of a character class: the characters of the basic plane in a Unicode category."""
    found, start = "", None
    for c in range(0x10001):
        inside = c < 0x10000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            found, start = found + rf"\u{start:04x}-\u{c - 1:04x}", None
    return found


class Encoder:
    """Ids of texts by the tokenizers library, which sees every distinct pre-token once.

    Byte-level BPE never merges across pre-tokens, so their ids can be kept and joined.
    The memory is bounded: it starts over after ``limit`` pre-tokens.
    """

    def __init__(self, path: str, limit: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for name, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(name)  # a character of the vocabulary stands for a byte
        self.limit = limit
        self.known: dict[str, bytes] = {}
        added = added_tokens(path)
        self.split = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.any = regex.compile(PRE_TOKEN)
        letter, number = _ranges("L"), _ranges("N")
        # the same rule with spelled-out classes, which `re` runs three times as fast
        self.basic = re.compile(
            rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        )

    def _pre_tokens(self, text: str) -> list[str]:
        pattern = self.basic if text.isascii() or max(text) < "\U00010000" else self.any
        if self.split is None:
            return pattern.findall(text)
        parts = self.split.split(text)
        return [t for i, p in enumerate(parts) for t in ([p] if i % 2 else pattern.findall(p))]

    def _learn(self, tokens: list[str]) -> None:
        """Remember the ids of ``tokens``.

        Tokens of a space and letters are encoded many at a time: one after the other they make a text
        that is split into the same tokens again, whose ids end where the bytes of the tokens end.
        """
        spaced = [t for t in tokens if t[0] == " " and t[1:2].isalpha()]
        for at in range(0, len(spaced), JOINED):
            part = spaced[at:at + JOINED]
            ids = np.array(self.tokenizer.encode("".join(part), add_special_tokens=False).ids, self.dtype)
            ends = np.cumsum([len(t.encode()) for t in part])
            spelt = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(spelt, ends) + 1
            if not np.array_equal(spelt[cuts - 1], ends):
                raise ValueError("the tokenizer joins pre-tokens")
            raw, width = ids.tobytes(), self.dtype.itemsize
            bounds = [0, *(cuts * width).tolist()]
            self.known.update((t, raw[a:b]) for t, a, b in zip(part, bounds[:-1], bounds[1:]))
        rest = [t for t in tokens if not (t[0] == " " and t[1:2].isalpha())]
        encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.known.update((t, np.array(e.ids, self.dtype).tobytes()) for t, e in zip(rest, encoded))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        split = [self._pre_tokens(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, which later tasks use again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends documents to a shard; holds less than one batch of sequences."""

    def __init__(self, address: str, dtype: np.dtype, length: int, batch: int = 256):
        self.schema, self.dtype, self.length, self.size = _schema(dtype, length), dtype, length, batch * length
        self.out = create(address)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.open, self.held, self.total, self.sequences = [], 0, 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes, n: int) -> None:
        self.docs.append((doc_id, self.total, n))
        self.total += n
        self.open.append(ids)
        self.held += n
        if self.held >= self.size:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.open), self.dtype)
        whole = len(ids) // self.length * self.length
        pad = -len(ids) % self.length if last else 0
        now = np.concatenate([ids, np.zeros(pad, self.dtype)]) if last else ids[:whole]
        self.open = [] if last else [ids[whole:].tobytes()]
        self.held = 0 if last else len(ids) - whole
        mask = np.ones(len(now), bool)
        mask[len(now) - pad:] = False
        for at in range(0, len(now), self.size):
            part = slice(at, at + self.size)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (now, mask)]
            self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.sequences += len(now) // self.length

    def close(self, docs_address: str) -> None:
        if self.held:
            self._flush(last=True)
        self.file.close()
        self.out.close()
        ids, starts, counts = (list(x) for x in zip(*self.docs)) if self.docs else ([], [], [])
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with create(docs_address) as out, pa.ipc.new_file(out, table.schema) as f:
            f.write_table(table)


class Shard:
    """Random access to the sequences of a shard without copying the mapped file."""

    def __init__(self, address: str):
        reader = pa.ipc.open_file(open_mapped(address))
        batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
        self.length = reader.schema.field("ids").type.list_size
        self.ids = [b.column("ids").values.to_numpy() for b in batches]
        self.masks = [b.column("mask").values for b in batches]
        self.firsts = np.cumsum([0] + [len(x) for x in self.ids])

    def __len__(self) -> int:
        return int(self.firsts[-1]) // self.length

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = int(np.searchsorted(self.firsts, i * self.length, "right")) - 1
        at = i * self.length - int(self.firsts[b])
        return self.ids[b][at:at + self.length], self.masks[b].slice(at, self.length)

    def slices(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, batch by batch."""
        b = int(np.searchsorted(self.firsts, start, "right")) - 1
        while n > 0:
            at = start - int(self.firsts[b])
            part = self.ids[b][at:at + n]
            yield part
            start, n, b = start + len(part), n - len(part), b + 1


def write_token_files(docs: DataFrame, folder: str, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) into shards in ``folder``; returns the committed manifest.

    Documents follow each other in ascending ``doc_id`` (NULL first; rows that share an id in
    the order of their texts), each with ``end_id`` appended. NULL text counts as empty and
    leaves the end id alone. An empty table gives an empty manifest. Other columns are not read.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc, out = encoder(path), None
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        for b in batches:
            if not b.num_rows:
                continue
            out = out or ShardWriter(f"{folder}/{name}.arrow", enc.dtype, length)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                out.add(doc_id, ids + end, len(ids) // enc.dtype.itemsize + 1)
        if out is not None:
            out.close(f"{folder}/{name}.docs.arrow")
            row = [shard], [name], [out.sequences], [out.total], [len(out.docs)]
            types = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], ["shard", "file", "n_sequences", "n_tokens", "n_docs"])

    order = F.col("doc_id").asc_nulls_first()
    placed = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(order).sortWithinPartitions(order, "text")
    placed.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as the files hold them: ``doc_id, start, n_tokens, ids_crc32``."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first").to_pylist()):
                shard = Shard(f"{folder}/{name}.arrow")
                docs = pa.ipc.open_file(open_mapped(f"{folder}/{name}.docs.arrow")).read_all().to_batches(max_chunksize=10_000)
                for d in docs:
                    sums = []
                    for start, n in zip(d.column("start").to_pylist(), d.column("n_tokens").to_pylist()):
                        crc = 0
                        for part in shard.slices(start, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(d.column("start").to_numpy() + first, pa.int64())
                    yield pa.record_batch(
                        [d.column("doc_id"), starts, d.column("n_tokens"), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = shards.repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary_path("byte_bpe_50k.json"))
    return read_documents(spark, folder)


SQL = None
