"""Alignment of two tokenizations by divide and conquer at shared cuts.

The tokens of both tokenizers cover the same bytes. Where a token of each ends, the text is
cut. Cuts are found by dividing: near the middle of an interval a common end is located by
bisection, both halves go on by themselves, and an interval without a common end is a group.

The first cuts need no search. White space and signs that both tokenizers are known to cut at
divide a text into chunks, each of which has the same tokens wherever it stands. So a worker aligns
a distinct chunk once and puts documents together from remembered chunks.

Which pairs of ids are linked in a document is written once. Documents with a pair are counted
by Spark, the counts are stored as sorted arrays in the shared folder, and a second pass looks
them up in the mapped files; no text or link is shuffled but for the counting.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table
from firnline.llm.kneser_ney import _runs
from firnline.llm.sentencepiece import MARK, read_model
from firnline.llm.shared_files import mapped_array, new_folder, write_array
from firnline.llm.shingles import in_slices
from firnline.llm.token_counts import added_tokens, vocabulary_path
from firnline.session import materialise

QUERY = "op11_token_alignment"

#: Chunks that a worker remembers.
REMEMBERED = 300_000
#: Bytes of text that are aligned at once.
SLICE = 2 << 20
#: Pairs in a slice of the stored counts.
SLICE_PAIRS = 1 << 20


def shared_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in two ascending lists of ends, one past a common end each; the last ends must be the same."""
    if not a and not b:
        return []
    cuts = [(len(a), len(b))]
    todo = [(0, len(a) - 1, 0, len(b) - 1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        middle = (a0 + a1) // 2
        for step in range(a1 - a0):
            # the middle, then one to the left and right of it, then two: all of the interval
            i = middle + (step // 2 if step % 2 == 0 else -(step // 2) - 1)
            j = bisect_left(b, a[i], b0, b1)
            if j < b1 and b[j] == a[i]:
                cuts.append((i + 1, j + 1))
                todo += [(a0, i, b0, j), (i + 1, a1, j + 1, b1)]
                break
    return sorted(cuts)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encodings:
    """Ids and token bytes of both tokenizers for chunks of text: A sees them as they are, B adds a space to a text."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        added = set(added_tokens(path_a))
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab().items():
            self.bytes_a[i] = name.encode() if name in added else bytes(alphabet[c] for c in name)
        pieces = read_model(path_b)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        for byte, i in enumerate(pieces.bytes_):
            self.bytes_b[i] = bytes([byte])
        self.size_b = len(self.bytes_b)
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        # no piece joins a line end to anything, or texts are cut at spaces only
        lines_apart = not any("\n" in p and len(p) > 1 for p, _, _ in pieces.rows)
        self.split = _chunks(pieces.apart) if lines_apart else _CAREFUL
        self._line = self.b.encode("\n")

    def of(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # a chunk without a space in front is encoded behind a line end, which is taken off again
        spaced = [len(c) > 1 and c[0] == " " for c in chunks]
        found_b = self.b.encode([c[1:] if s else "\n" + c for c, s in zip(chunks, spaced)], num_threads=1)
        n = len(self._line)
        return found_a, [ids if s else ids[n:] for ids, s in zip(found_b, spaced)]


#: Letters that A never joins to signs or digits in front of them, but for an apostrophe, or behind them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks of any text: both cut before a space that follows anything but white space.
_CAREFUL = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*").findall
_OTHER_SPACE = re.compile(r"[^\S \n]").search


def _chunks(apart: str):
    """Splitter of texts whose only white space is spaces and line ends.

    Both tokenizers cut before white space that follows something else and around a line end that
    something else follows, and between letters and the signs and digits in ``apart``.
    """
    behind, before = (re.escape("".join(c for c in apart if c.isascii() and c not in x)) for x in ("", "'"))
    other = rf"[^\s{_LETTER}]+"
    if not behind:
        return re.compile(r"\s+(?=\n\S)|\n(?=\S)|\s*\S+|\s+").findall
    word = rf"(?:[{_LETTER}]+|{other})(?:(?<=[{_LETTER}])(?![{behind}]){other}|(?<![{_LETTER}{before}])[{_LETTER}]+)*"
    return re.compile(rf"\s+(?=\n\S)|\n(?=\S)|\s*{word}|\s+").findall


class Aligner:
    """Aligns texts from remembered chunks; starts over when it knows ``limit`` of them."""

    def __init__(self, path_a: str, path_b: str, limit: int = REMEMBERED):
        self.encodings, self.limit = Encodings(path_a, path_b), limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: dict[str, str] = {}
        #: n_a, n_b, n_groups, n_links and whether the bytes differ, for each chunk
        self.counts = np.zeros((1024, 5), np.int64)
        self.pairs, self.times = np.zeros(4096, np.int64), np.zeros(4096, np.int64)
        self.ends = np.zeros(1025, np.int64)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return (_CAREFUL if _OTHER_SPACE(text) else self.encodings.split)(" " + text)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        grown = np.zeros((max(n, 2 * len(array)), *array.shape[1:]), array.dtype)
        grown[:len(array)] = array
        return grown

    def _learn(self, chunks: list[str]) -> None:
        e, known = self.encodings, len(self.index)
        self.index.update(zip(chunks, range(known, known + len(chunks))))
        counts, sizes, pairs, times = [], [], [], []
        for chunk, ids_a, ids_b in zip(chunks, *e.of(chunks)):
            raw, tokens_a, tokens_b = chunk.encode(), [e.bytes_a[i] for i in ids_a], [e.bytes_b[i] for i in ids_b]
            if b"".join(tokens_a) != raw or b"".join(tokens_b) != raw:
                counts.append((0, 0, 0, 0, 1))
                sizes.append(0)
                continue
            names_a, names_b = [e.names[i] for i in ids_a], [e.names[i] for i in ids_b]
            texts, i0, j0, n, links = [], 0, 0, 0, {}
            one = len(ids_a) == 1 or len(ids_b) == 1
            cuts = [(len(ids_a), len(ids_b))] if one else shared_cuts([*accumulate(map(len, tokens_a))], [*accumulate(map(len, tokens_b))])
            for i, j in cuts:
                if i - i0 == j - j0 == 1:
                    texts.append(f"{names_a[i0]}|{names_b[j0]}")
                    pair = ids_a[i0] * e.size_b + ids_b[j0]
                    links[pair] = links.get(pair, 0) + 1
                    n += 1
                else:
                    texts.append(f"{','.join(names_a[i0:i])}|{','.join(names_b[j0:j])}")
                    in_a, in_b = Counter(ids_a[i0:i]), Counter(ids_b[j0:j])
                    n += (i - i0) * (j - j0)
                    for x, times_a in in_a.items():
                        for y, times_b in in_b.items():
                            links[x * e.size_b + y] = links.get(x * e.size_b + y, 0) + times_a * times_b
                i0, j0 = i, j
            counts.append((len(ids_a), len(ids_b), len(cuts), n, 0))
            self.groups[chunk] = ";".join(texts)
            sizes.append(len(links))
            pairs += links
            times += links.values()
        end = int(self.ends[known])
        self.counts, self.ends = self._room(self.counts, known + len(counts)), self._room(self.ends, known + len(counts) + 1)
        self.pairs, self.times = self._room(self.pairs, end + len(pairs)), self._room(self.times, end + len(pairs))
        self.counts[known:known + len(counts)] = counts
        self.ends[known + 1:known + len(counts) + 1] = end + np.cumsum(sizes)
        self.pairs[end:end + len(pairs)], self.times[end:end + len(pairs)] = pairs, times

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts ``n_a, n_b, n_groups, n_links`` and groups of each text; the links of all: ends, pairs and times."""
        split = [self.chunks(t) for t in texts]
        if len(self.index) > self.limit:
            self._clear()
        new = set().union(*split).difference(self.index)
        if new:
            self._learn(sorted(new))
        n = len(split)
        sizes = np.fromiter(map(len, split), np.int64, n)
        owner = np.repeat(np.arange(n), sizes)
        place = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        counts = np.zeros((n, 5), np.int64)
        np.add.at(counts, owner, self.counts[place])
        good = counts[:, 4] == 0
        counts[~good] = 0
        groups = [";".join(map(self.groups.__getitem__, s)) if ok else "" for s, ok in zip(split, good.tolist())]

        # chunks of a document once, then their links, then equal links together
        size = len(self.index) + 1
        chosen = good[owner]
        keys, seen = np.unique(owner[chosen] * size + place[chosen], return_counts=True)
        doc, chunk = keys // size, keys % size
        m = self.ends[chunk + 1] - self.ends[chunk]
        at = np.repeat(self.ends[chunk] - np.cumsum(m) + m, m) + np.arange(m.sum())
        doc, pair, times = np.repeat(doc, m), self.pairs[at], self.times[at] * np.repeat(seen, m)
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))[:len(doc)])
        ends = np.searchsorted(doc[first], np.arange(n + 1))
        return counts[:, :4], groups, ends, pair[first], np.add.reduceat(times, first) if len(first) else times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker, which later tasks use again."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<bigint>"


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True) -> DataFrame:
    """Groups and links of each row of ``docs`` (``doc_id``, ``text``), before any counting over the corpus.

    ``pairs`` are the distinct linked ids, ``a`` times the size of B's vocabulary plus ``b``, and ``times``
    how many links each has. ``groups`` is NULL unless ``with_groups``.
    """
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(path_a, path_b)
        for b in (part for whole in batches for part in in_slices(whole, most_bytes=SLICE)):
            counts, groups, ends, pairs, times = of.align([t or "" for t in b.column("text").to_pylist()])
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(counts[:, i]) for i in range(4)), pa.array(digests, pa.string()),
                 pa.array(groups if with_groups else [None] * len(groups), pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))],
                ["doc_id", *_NUMBERS, "groups_sha256", "groups", "pairs", "times"],
            )

    return docs.select("doc_id", "text").mapInArrow(align, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """In how many rows of ``aligned`` each pair of ids is linked: ``pair, n``."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


class StoredCounts:
    """Counts of pairs in sorted arrays, in files that workers map; all pairs of an id of A are in one slice."""

    def __init__(self, folder: str, slices: int, size_b: int, files: dict[int, str]):
        self.folder, self.slices, self.size_b, self.files = folder, slices, size_b, files

    def open(self) -> StoredCounts:
        types = {"pair": "<i8", "n": "<i8", "best": "u1"}
        self.parts = {s: [mapped_array(f"{self.folder}/{f}.{n}", t) for n, t in types.items()] for s, f in self.files.items()}
        return self

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, and 1 where no pair of the same id of A has more."""
        where = (pairs // self.size_b) % self.slices
        order = np.argsort(where, kind="stable")
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for s, run in _runs(where[order]):
            keys, n, top = self.parts[int(s)]
            of = order[run]
            at = np.searchsorted(keys, pairs[of])
            counts[of], best[of] = n[at], top[at]
        return counts, best


def store_counts(counts: DataFrame, size_b: int, folder: str) -> StoredCounts:
    """Write ``counts`` (``pair, n``) by slices that grow in number with the pairs."""
    slices = max(1, -(-counts.count() // SLICE_PAIRS))
    schema = "slice int, file string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            pair, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            a = pair // size_b
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a))))
            name = f"counts-{now:06d}-{uuid.uuid4().hex}"
            for suffix, values in (("pair", pair.astype("<i8")), ("n", n.astype("<i8")), ("best", (n == most).astype("u1"))):
                write_array(f"{folder}/{name}.{suffix}", values)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name], pa.string())], ["slice", "file"])

        for b in batches:
            pair, n = b.column("pair").to_numpy(), b.column("n").to_numpy()
            for s, part in _runs(b.column("slice").to_numpy()):
                if s != now:
                    if held:
                        yield flush()
                    now, held = int(s), []
                held.append((pair[part], n[part]))
        if held:
            yield flush()

    sliced = counts.select((F.floor(F.col("pair") / size_b) % slices).cast("int").alias("slice"), "pair", "n")
    placed = sliced.repartition(slices, "slice").sortWithinPartitions("slice", "pair")
    placed.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    files = counts.sparkSession.read.schema(schema).parquet(f"{folder}/manifest").collect()  # one for each slice
    return StoredCounts(folder, slices, size_b, {r.slice: r.file for r in files})


def token_alignment(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True, folder: str | None = None) -> DataFrame:
    """Align the tokens of a byte-level BPE (A, on a space and the text) and a SentencePiece model (B) of each row of ``docs``.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with
    ``with_groups``, ``groups``: ids of A before and of B behind ``|`` in groups parted by ``;``.
    Links are all pairs of tokens in one group. The count of a pair of ids is the number of rows
    that link it; ``count_sum`` adds it up over the links, and ``n_best`` counts the links whose
    count no other pair with the same id of A exceeds.

    One row for each input row, whole texts. NULL and empty texts, and texts that the tokens of
    either side do not spell (those with U+2581, which B reads as a space), have no tokens: zeros and
    an empty string. Rows that repeat an id or a text count as rows of their own, NULL ids too. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = materialise(aligned(docs, path_a, path_b, with_groups))
    size_b = read_model_size(path_b)
    table = store_counts(materialise(pair_counts(rows)), size_b, folder or new_folder(docs.sparkSession))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = table.open()
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            sizes = np.diff(pairs.offsets.to_numpy())
            n, best = opened.look_up(pairs.flatten().to_numpy())
            times = times.flatten().to_numpy()
            sums = [np.concatenate([[0], np.cumsum(x * times)]) for x in (best, n)]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            kept = [b.column(c) for c in ("doc_id", *_NUMBERS, "groups_sha256", "groups")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)],
                ["doc_id", *_NUMBERS, "groups_sha256", "groups", "n_best", "count_sum"],
            )

    schema = _ALIGNED.partition(", pairs")[0] + ", n_best bigint, count_sum bigint"
    found = rows.mapInArrow(count, schema).select(
        "doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])
    )
    return found


def read_model_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_alignment(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"), with_groups=False)


SQL = None
