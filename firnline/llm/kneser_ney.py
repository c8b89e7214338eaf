"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by the workers.

Training is three passes of map, shuffle and merge. Tasks count what they read in sorted
arrays and send each slice of the key range, packed, to one merging task:

1. words, by hash: the merged slices are the vocabulary, and the rank of a word is its id;
2. pairs of ids, by a hash of context and word in which a frequent context spreads over
   ``SPREAD`` slices: the merged slices are sorted arrays of pairs and their counts;
3. what the pairs say about single words, by id: how often and with how many words a
   context goes on, and behind how many contexts a word stands.

Every slice is a file in the shared folder under a name of its own, and counts only when a
committed manifest names it. Scoring maps the files and looks whole batches up by binary
search. The model grows with the corpus and is never gathered anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import crc_mod, read_table
from firnline.llm.shared_files import mapped_array, new_folder, write_array
from firnline.llm.shingles import in_slices, mix, word_hashes

QUERY = "op8_kneser_ney"

#: Keys that a task holds before it sends them on, and slices that a context spreads over.
HELD, SPREAD = 4_000_000, 8
_END = mix(np.array([1], np.uint64))[0]
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end behind each, and where each text begins (n + 1 numbers)."""
    words, bounds = word_hashes(texts, _NOT_SPACE)
    ends = bounds[1:]
    return np.insert(words, ends, _END), bounds + np.arange(len(bounds))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, which compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences, with 32-bit columns."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    data = b"".join([_planes(steps), *(_planes(c.astype("<u4")) for c in columns)])
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data, max_output_size=n * (8 + 4 * columns))
    with np.errstate(over="ignore"):
        keys = np.cumsum(_unplanes(data[:8 * n], "<u8"), dtype=np.uint64)
    parts = [data[(8 + 4 * i) * n:(12 + 4 * i) * n] for i in range(columns)]
    return [keys, *(_unplanes(p, "<u4").astype(np.int64) for p in parts)]


_PACKED = "slice int, n int, data binary"


def _packed(slices: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each slice that has keys."""
    order = np.lexsort((keys, slices))
    slices, keys, columns = slices[order], keys[order], [c[order] for c in columns]
    present, first = np.unique(slices, return_index=True)
    bounds = np.append(first, len(slices))
    rows = [pack(keys[a:b], *(c[a:b] for c in columns)) for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int32()), pa.array(np.diff(bounds), pa.int32()), pa.array(rows, pa.binary())], ["slice", "n", "data"]
    )


def _by_slice(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The unpacked rows of each slice, summed by key as they come; the input is sorted by slice."""
    now, held = None, []

    def merged() -> list[np.ndarray]:
        keys = np.concatenate([h[0] for h in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return [keys[first], *(np.add.reduceat(np.concatenate([h[i] for h in held])[order], first) for i in range(1, columns + 1))]

    for b in batches:
        for s, n, data in zip(b.column("slice").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist()):
            if s != now:
                if held:
                    yield now, merged()
                now, held = s, []
            held.append(unpack(data, n, columns))
            if len(held) > 64:
                held = [merged()]
    if held:
        yield now, merged()


def _slices(spark: SparkSession) -> int:
    """A power of two that is no smaller than the number of shuffle partitions."""
    return 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def _top(keys: np.ndarray, slices: int) -> np.ndarray:
    return (keys >> np.uint64(64 - slices.bit_length() + 1)).astype(np.int32) if slices > 1 else np.zeros(len(keys), np.int32)


def pair_slice(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slice of pairs ``context << 32 | word``."""
    context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        return _top(mix(context * np.uint64(SPREAD) + word % np.uint64(SPREAD) + np.uint64(1)), slices)


@dataclass
class Vocabulary:
    """Sorted word hashes in slices; the rank of a word over all slices is its id."""

    folder: str
    slices: int
    files: dict[int, str]
    firsts: dict[int, int]
    size: int
    tokens: int

    def open(self) -> Vocabulary:
        self.hashes = {s: mapped_array(f"{self.folder}/{f}.keys", "<u8") for s, f in self.files.items()}
        self.counts = {s: mapped_array(f"{self.folder}/{f}.counts", "<u4") for s, f in self.files.items()}
        return self

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id, or -1, and training count of each."""
        unique, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        for s, part in _runs(_top(unique, self.slices)):
            if s in self.hashes:
                at, known = _find(self.hashes[s], unique[part])
                ids[part] = np.where(known, at + self.firsts[s], -1)
                counts[part] = np.where(known, self.counts[s][at], 0)
        return ids[back], counts[back]


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else []
    for a, b in zip(first, [*first[1:], len(values)]):
        yield int(values[a]), slice(int(a), int(b))


def _find(array: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(array, wanted), len(array) - 1)
    return at, array[at] == wanted


def count_words(docs: DataFrame, folder: str) -> Vocabulary:
    slices = _slices(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for b in (part for whole in batches for part in in_slices(whole)):
            k, c = np.unique(token_hashes(b.column("text"))[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                k, c = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k], [c], len(k)
                if held > HELD // 2:
                    yield _packed(_top(k, slices), k, c)
                    keys, counts, held = [], [], 0
        if keys:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            yield _packed(_top(k, slices), k, c)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (keys, counts) in _by_slice(batches, 1):
            name = f"words-{s:06d}-{uuid.uuid4().hex}"
            write_array(f"{folder}/{name}.keys", keys.astype("<u8"))
            write_array(f"{folder}/{name}.counts", np.minimum(counts, 2**32 - 1).astype("<u4"))
            yield _row(s, name, len(keys), int(counts.sum()))

    rows = _manifest(_shuffled(docs.select("text").mapInArrow(count, _PACKED)).mapInArrow(merge, _MANIFEST), f"{folder}/words")
    firsts = np.cumsum([0] + [r.n for r in rows]).tolist()
    if firsts[-1] >= 1 << 32:
        raise ValueError("the vocabulary has more words than 32-bit ids")
    return Vocabulary(
        folder, slices, {r.slice: r.file for r in rows}, {r.slice: f for r, f in zip(rows, firsts)}, firsts[-1], sum(r.total for r in rows)
    )


_MANIFEST = "slice int, file string, n bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _row(s: int, file: str, n: int, total: int, counts: np.ndarray | None = None) -> pa.RecordBatch:
    of = [0] * 4 if counts is None else [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    values = [s, file, n, total, *of]
    types = [pa.int32(), pa.string(), *[pa.int64()] * 6]
    names = ["slice", "file", "n", "total", "n1", "n2", "n3", "n4"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)


def _shuffled(packed: DataFrame) -> DataFrame:
    return packed.repartition("slice").sortWithinPartitions("slice")


def _manifest(rows: DataFrame, path: str) -> list:
    """Commit the manifest and read it back: one row for each slice."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(_MANIFEST).parquet(path).orderBy("slice").collect()


def contexts_and_words(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The id in front of each token; texts begin behind ``start``."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = start
    return before


def count_pairs(docs: DataFrame, folder: str, vocabulary: Vocabulary) -> tuple[list, DataFrame]:
    """Manifest of the pair files, and a committed table of what the pairs say about their words."""
    slices, start = vocabulary.slices, vocabulary.size
    wide = -(-(start + 1) // slices)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.open()
        keys, counts, held = [], [], 0
        for b in (part for whole in batches for part in in_slices(whole)):
            hashes, bounds = token_hashes(b.column("text"))
            ids, _ = known.look_up(hashes)
            pairs = contexts_and_words(ids, bounds, start).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)
            k, c = np.unique(pairs, return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                k, c = summed(np.concatenate(keys), np.concatenate(counts))
                yield _packed(pair_slice(k, slices), k, c)
                keys, counts, held = [], [], 0
        if keys:
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            yield _packed(pair_slice(k, slices), k, c)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (keys, counts) in _by_slice(batches, 1):
            name = f"pairs-{s:06d}-{uuid.uuid4().hex}"
            write_array(f"{folder}/{name}.keys", keys.astype("<u8"))
            write_array(f"{folder}/{name}.counts", np.minimum(counts, 2**32 - 1).astype("<u4"))
            done = _row(s, name, len(keys), int(counts.sum()), counts)
            words, behind = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            first = np.flatnonzero(np.append(True, np.diff(keys >> np.uint64(32)) > 0))
            contexts = (keys >> np.uint64(32))[first]
            total, *of = (np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2))
            zero, none = np.zeros(len(words), np.int64), np.zeros(len(contexts), np.int64)
            ids, *facts = np.append(contexts, words), *(np.append(a, b) for a, b in zip((total, *of, none), (zero, zero, zero, zero, behind)))
            parts = _packed((ids // np.uint64(wide)).astype(np.int32), ids, *facts)
            m = parts.num_rows
            nothing = [pa.nulls(m, f.type) for f in done.schema]
            yield pa.RecordBatch.from_arrays([*done.columns, pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.binary())], names)
            yield pa.RecordBatch.from_arrays([*nothing, *parts.columns], names)

    names = ["slice", "file", "n", "total", "n1", "n2", "n3", "n4", "id_slice", "id_n", "data"]
    schema = f"{_MANIFEST}, id_slice int, id_n int, data binary"
    _shuffled(docs.select("text").mapInArrow(count, _PACKED)).mapInArrow(merge, schema).write.parquet(f"{folder}/pairs")
    both = docs.sparkSession.read.schema(schema).parquet(f"{folder}/pairs")
    rows = both.where("file IS NOT NULL").drop("id_slice", "id_n", "data").orderBy("slice").collect()
    return rows, both.where("data IS NOT NULL").select(F.col("id_slice").alias("slice"), F.col("id_n").alias("n"), "data")


def sum_words(facts: DataFrame, folder: str, vocabulary: Vocabulary) -> list:
    """Dense arrays by id: tokens behind it, words seen once, twice and more behind it, contexts in front of it."""
    wide = -(-(vocabulary.size + 1) // vocabulary.slices)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (ids, *columns) in _by_slice(batches, 5):
            table = np.zeros((wide, 5), "<u4")
            table[(ids - np.uint64(s * wide)).astype(np.int64)] = np.minimum(np.stack(columns, axis=1), 2**32 - 1)
            name = f"ids-{s:06d}-{uuid.uuid4().hex}"
            write_array(f"{folder}/{name}", table)
            yield _row(s, name, len(ids), int(columns[4].sum()), columns[4])

    return _manifest(_shuffled(facts).mapInArrow(merge, _MANIFEST), f"{folder}/ids")


def discounts(rows: list) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts."""
    n1, n2, n3, n4 = (sum(getattr(r, f"n{i}") for r in rows) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    ratio = lambda a, b: a / b if b else 0.0
    raw = 1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3)
    # too small a corpus gives none; a discount stays within what there is to take off
    return tuple(min(max(d, 0.1), i) for d, i in zip(raw, (1.0, 2.0, 3.0)))


@dataclass
class Model:
    vocabulary: Vocabulary
    pair_files: dict[int, str]
    id_files: dict[int, str]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pairs: int
    taken: float

    def open(self) -> Model:
        v = self.vocabulary.open()
        self.wide = -(-(v.size + 1) // v.slices)
        self.keys = {s: mapped_array(f"{v.folder}/{f}.keys", "<u8") for s, f in self.pair_files.items()}
        self.counts = {s: mapped_array(f"{v.folder}/{f}.counts", "<u4") for s, f in self.pair_files.items()}
        self.ids = {s: mapped_array(f"{v.folder}/{f}", "<u4").reshape(-1, 5) for s, f in self.id_files.items()}
        return self

    def _facts(self, ids: np.ndarray) -> np.ndarray:
        """The row of each id; zeros for unknown words."""
        unique, back = np.unique(ids, return_inverse=True)
        rows = np.zeros((len(unique), 5), np.int64)
        for s, part in _runs(unique // self.wide):
            if s in self.ids:
                rows[part] = self.ids[s][unique[part] - s * self.wide]
        return rows[back]

    def _pair_counts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        known = (contexts >= 0) & (words >= 0)
        keys = contexts[known].astype(np.uint64) << np.uint64(32) | words[known].astype(np.uint64)
        unique, back = np.unique(keys, return_inverse=True)
        where = pair_slice(unique, self.vocabulary.slices)
        order = np.argsort(where, kind="stable")
        found = np.zeros(len(unique), np.int64)
        for s, part in _runs(where[order]):
            if s in self.keys:
                at, same = _find(self.keys[s], unique[order[part]])
                found[order[part]] = np.where(same, self.counts[s][at], 0)
        counts = np.zeros(len(words), np.int64)
        counts[known] = found[back]
        return counts

    @staticmethod
    def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)

    def probabilities(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word behind its context; -1 is an unknown word."""
        behind, front = self._facts(contexts), self._facts(words)
        pairs = max(self.pairs, 1)
        rest = self.taken / pairs if self.pairs else 1.0
        word = self._discounted(front[:, 4], self.word_discounts) / pairs + rest / (self.vocabulary.size + 1)
        total = np.maximum(behind[:, 0], 1)
        kept = self._discounted(self._pair_counts(contexts, words), self.pair_discounts) / total
        left = np.where(behind[:, 0] > 0, behind[:, 1:4] @ np.array(self.pair_discounts) / total, 1.0)
        return kept + left * word


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Count the texts of ``docs`` (``text``) into a model in ``folder``, by default a new one in the shared folder.

    NULL and empty texts are a single end. Without any row the model is uniform.
    """
    folder = folder or new_folder(docs.sparkSession)
    vocabulary = count_words(docs, folder)
    pair_rows, facts = count_pairs(docs, folder, vocabulary)
    id_rows = sum_words(facts, folder, vocabulary)
    words = discounts(id_rows)
    of = [sum(getattr(r, f"n{i}") for r in id_rows) for i in (1, 2)]
    # ids without a context in front are the start of texts alone
    more = vocabulary.size - sum(of)
    return Model(
        vocabulary, {r.slice: r.file for r in pair_rows}, {r.slice: r.file for r in id_rows}, discounts(pair_rows), words,
        sum(r.n for r in pair_rows), words[0] * of[0] + words[1] * of[1] + words[2] * more,
    )


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Log10 probabilities of the rows of ``docs`` (``doc_id``, ``text``) and the perplexity.

    One row for each input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity``. Tokens are the words between ASCII white space, A-Z lower-cased, and
    one end; ``base_score`` is that of single tokens with one added to every count. NULL and
    empty texts are a single end. Unknown words share the mass that the model keeps for them.
    Rows are scored by their text alone; repeated and NULL ids and other columns play no part.
    """
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = model.open()
        n, v = model.vocabulary.tokens, model.vocabulary.size
        for b in (part for whole in batches for part in in_slices(whole)):
            hashes, bounds = token_hashes(b.column("text"))
            ids, counts = opened.vocabulary.look_up(hashes)
            logs = np.log10(opened.probabilities(contexts_and_words(ids, bounds, v), ids))
            base = np.log10((counts + 1) / (n + v + 1))
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), base, logs)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.diff(bounds), pa.int64()), *map(pa.array, sums)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    scored = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run_batches, _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(True))
    return score(docs, train(docs.where(~held_out)), held_out)


SQL = None
