"""SentencePiece encoding and decoding over a relational lattice.

Pieces hold a space mark at their start only, and no piece mixes letters with certain other
characters, so a text is encoded word by word, and each distinct word of the corpus is
encoded once: its substrings of bounded length are exploded
and equi-joined to the piece table, the edges that remain are grouped by word, and a fold
with Spark's ``aggregate`` picks the path. For a unigram model the fold is Viterbi. A BPE
model has no path scores to add up: there the fold takes, step by step, the best-scored
edge that joins two neighbouring symbols, which is how such a model is defined. In words where
no merge can make way for a better one, as the pieces show, one visit of the edges does the same.

The encoded words are written as sorted hash arrays to the shared folder. Documents look
their words up in the mapped files, so no text is shuffled and a frequent word costs
nothing extra.
"""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table
from firnline.llm.kneser_ney import _find, _runs, _shuffled, _slices, _top
from firnline.llm.rows import releasing
from firnline.llm.shared_files import mapped_array, new_folder, write_array
from firnline.llm.token_counts import vocabulary_path
from firnline.session import materialise

QUERY = "op5_sentencepiece"

MARK = "▁"
#: The lattice of a word keeps its symbol bounds in a 64-bit mask; longer words go through the library.
LONGEST = 60
#: Encoded words that a worker remembers.
REMEMBERED = 300_000


@dataclass
class Pieces:
    """The content of a model: ``rows`` are the pieces that text can match, ``bytes_`` the ids of single bytes.

    ``apart`` are characters that no piece joins with any others, so that words end at them; ``letters`` are the
    others that pieces join. What is in neither is a word of its own.
    """

    path: str
    kind: str
    rows: list[tuple[str, int, float]]
    bytes_: list[int]
    longest: int
    apart: str = ""
    letters: str = ""

    @property
    def word(self) -> str:
        """Pattern of a word."""
        apart, letters = ("".join(f"\\U{ord(c):08x}" for c in part) for part in (self.apart, self.letters))
        if not apart:
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        if not letters:
            return f"{MARK}*(?:[^{MARK}{apart}]+|[{apart}]+)|{MARK}+"
        return f"{MARK}*(?:[{letters}]+|[{apart}]+)|[^{MARK}{apart}{letters}]|{MARK}+"


def standing_apart(pieces: list[str]) -> str:
    """Punctuation and digits, with the other signs that pieces join to them; empty if they meet letters."""
    apart = set(string.punctuation + string.digits)
    while True:
        mixed = [p for p in pieces if len({c in apart for c in p.lstrip(MARK)}) > 1]
        more = {c for p in mixed for c in p.lstrip(MARK) if c not in apart}
        if not mixed:
            return "".join(sorted(apart))
        if any(unicodedata.category(c)[0] in "LM" or ord(c) > 0xFFFF for c in more):
            return ""
        apart |= more


def read_model(path: str, kind: str = "bpe") -> Pieces:
    """Pieces of a model file with byte fallback and no normalisation but space marks; fails for others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    bytes_ = [i for i in ids if model.is_byte(i)]
    rows = [(model.id_to_piece(i), i, model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    probe = "  ﬁ  Å\tx "
    if len(bytes_) != 256 or model.decode(model.encode(probe)) != probe:
        raise ValueError("only models with byte fallback and without normalisation are supported")
    if any(MARK in p.lstrip(MARK) for p, _, _ in rows) or not any(p == MARK for p, _, _ in rows):
        raise ValueError("pieces must hold space marks at their start only, and the mark must be one")
    names = [p for p, _, _ in rows]
    apart = standing_apart(names)
    letters = {c for p in names if len(p) > 1 for c in p} - {MARK, *apart}
    return Pieces(path, kind, rows, bytes_, max(map(len, names)), apart, "".join(sorted(letters)))


def late_pieces(pieces: Pieces) -> list[str]:
    """Pieces that a merge of a worse score may open to a merge; a word without them is merged in order of score.

    When that happens both ends of the piece are symbol bounds already, so the signs around it play no part and
    each piece is tried by itself.
    """
    scores = {p: s for p, _, s in pieces.rows}

    def late(piece: str) -> bool:
        n = len(piece)
        spans = ((piece[s:e], s, e) for s in range(n) for e in range(s + 2, n + 1))
        inner, turn = set(range(1, n)), (-scores[piece], 0, n)
        for edge in sorted((-scores[p], s, e) for p, s, e in spans if p in scores):
            _, s, e = edge
            if edge == turn:
                if len(inner) == 1:
                    return False
            elif (s == 0 or s in inner) and (e == n or e in inner):
                gone = inner.intersection(range(s + 1, e))
                if len(gone) == 1:
                    inner -= gone
                    if len(inner) == 1 and edge > turn:
                        return True
        return False

    return [p for p in scores if len(p) > 2 and late(p)]


def splitter(pieces: Pieces):
    """Function from a text to its words, each with the space marks in front of it; none in an empty text."""
    find = re.compile(pieces.word).findall
    return lambda text: find(MARK + text.replace(" ", MARK)) if text else []


def distinct_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Every word of ``docs`` once; tasks send each of their words once, or once in every ``REMEMBERED``."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(pieces), set()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(split(text or ""))
                if len(seen) > REMEMBERED:
                    yield pa.record_batch([pa.array(list(seen), pa.string())], ["word"])
                    seen = set()
        yield pa.record_batch([pa.array(list(seen), pa.string())], ["word"])

    return docs.select("text").mapInArrow(releasing(collect), "word string").distinct()


def lattice(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """``distinct`` (``word``) with ``edges``, the pieces at each place, best score first.

    An edge is one number that holds the rank of the score, the two places and the id, see ``_edge``.
    """
    scores = sorted({-s for _, _, s in pieces.rows})
    ranks = {s: r for r, s in enumerate(scores)}
    rows = [(p, i, ranks[-s]) for p, i, s in pieces.rows]
    table = distinct.sparkSession.createDataFrame(rows, "name string, id int, rank int").withColumn("hash", F.xxhash64("name"))
    starts = distinct.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.char_length("word") - F.col("s")))).alias("n"))
    substrings = spans.select("word", "s", (F.col("s") + F.col("n")).alias("e"), F.substring("word", F.col("s") + 1, F.col("n")).alias("piece"))
    # as many rows as the vocabulary of the model; a word without any piece keeps its first character
    # the join key is a hash, which is looked up faster than text; the texts are compared where hashes meet
    same = (F.xxhash64("piece") == F.col("hash")) & (F.col("piece") >= F.col("name")) & (F.col("piece") <= F.col("name"))
    met = substrings.join(F.broadcast(table), same, "left").where("id IS NOT NULL OR (s = 0 AND e = 1)")
    packed = F.expr("shiftleft(bigint(rank), 36) | shiftleft(bigint(s), 30) | shiftleft(bigint(e), 24) | id")
    # the words are already placed by word, so grouping them needs no shuffle
    return met.groupBy("word").agg(F.sort_array(F.collect_list(packed)).alias("edges"))


def _edge(x: Column) -> dict[str, Column]:
    """Parts of a packed edge: ids and ranks of 24 bits at most, places of 6."""
    return {
        "rank": F.shiftright(x, 36).cast("int"), "s": F.shiftright(x, 30).bitwiseAND(F.lit(63)).cast("int"),
        "e": F.shiftright(x, 24).bitwiseAND(F.lit(63)).cast("int"), "id": x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"),
    }


def _mask(s: Column, e: Column) -> tuple[Column, Column]:
    """Masks of the two places and of the places strictly between them."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    return bit(s).bitwiseOR(bit(e)), bit(e) - bit(s + 1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where a plain expression would be repeated in every lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged_in_order(edges: Column, length: Column) -> Column:
    """``merged`` by one visit of each edge, for words without ``late_pieces``."""
    def step(bounds: Column, x: Column) -> Column:
        s, e = _edge(x)["s"], _edge(x)["e"]
        inner = _mask(s, e)[1]
        fits = (F.getbit(bounds, s) == 1) & (F.getbit(bounds, e) == 1) & (F.bit_count(bounds.bitwiseAND(inner)) == 1)
        return F.when(fits, bounds.bitwiseAND(F.bitwise_not(inner))).otherwise(bounds)

    return F.aggregate(edges, F.call_function("shiftleft", F.lit(1).cast("bigint"), length + 1) - 1, step)


#: More late pieces than these are not looked for in each word.
LATE = 50


def merged_in_any_order(edges: Column, length: Column, late: list[str]) -> Column:
    """``merged``, by one visit in the words where that does the same."""
    if len(late) > LATE:
        return merged(edges, length)
    has_late = reduce(or_, (F.contains(F.col("word"), F.lit(p)) for p in late), F.lit(False))
    return F.when(has_late, merged(edges, length)).otherwise(merged_in_order(edges, length))


def merged(edges: Column, length: Column) -> Column:
    """Mask of the symbol bounds that byte-pair merging leaves, by folding over the edges of the lattice."""
    def masks(x: Column) -> Column:
        ends, inner = _mask(_edge(x)["s"], _edge(x)["e"])
        return F.struct(ends.alias("ends"), inner.alias("inner"))

    joins = F.transform(F.filter(edges, lambda x: _edge(x)["e"] - _edge(x)["s"] > 1), masks)
    all_bounds = F.call_function("shiftleft", F.lit(1).cast("bigint"), length + 1) - 1

    def fold(joins: Column) -> Column:
        def step(bounds: Column, _: Column) -> Column:
            fits = F.filter(joins, lambda x: (bounds.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(bounds.bitwiseAND(x["inner"])) == 1))
            best = F.get(fits, F.lit(0))
            return F.coalesce(bounds.bitwiseAND(F.bitwise_not(best["inner"])), bounds)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), all_bounds, step)

    return let(joins, fold)


def viterbi(edges: Column, length: Column, scores: list[float], unknown: float) -> Column:
    """Mask of the bounds of the best-scored path; a character without a piece scores ``unknown``.

    Of equal paths, the one whose last edge starts first is taken.
    """
    start = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.when(i == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("score"), F.when(i == 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("bounds")
    ))
    singles = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct((i + 1).alias("e"), i.alias("s"), F.lit(unknown).alias("score")))
    by_rank = F.array(*map(F.lit, scores))
    known = F.transform(edges, lambda x: F.struct(
        _edge(x)["e"].alias("e"), _edge(x)["s"].alias("s"), F.element_at(by_rank, _edge(x)["rank"] + 1).alias("score")
    ))
    missing = F.filter(singles, lambda u: ~F.exists(edges, lambda x: (_edge(x)["s"] == u["s"]) & (_edge(x)["e"] == u["e"])))
    in_order = F.sort_array(F.concat(known, missing))

    def step(best: Column, x: Column) -> Column:
        before = F.get(best, x["s"])
        score = before["score"] + x["score"]
        better = F.struct(score.alias("score"), before["bounds"].bitwiseOR(F.element_at(powers, x["e"] + 1)).alias("bounds"))
        return F.transform(best, lambda b, i: F.when((i == x["e"]) & (score > b["score"]), better).otherwise(b))

    powers = F.array(*[F.lit(1 << i).cast("bigint") for i in range(LONGEST + 1)])
    return F.aggregate(in_order, start, step, lambda best: F.element_at(best, length + 1)["bounds"])


def path_ids(folded: DataFrame, bounds: Column, byte_ids: list[int]) -> DataFrame:
    """``word, ids`` along the symbols between ``bounds``; characters without a piece become their bytes."""
    def fits(x: Column) -> Column:
        """Both ends are at bounds and none is between."""
        s, e = _edge(x)["s"], _edge(x)["e"]
        return (F.getbit("bounds", s) == 1) & (F.getbit("bounds", e) == 1) & (F.col("bounds").bitwiseAND(_mask(s, e)[1]) == 0)

    # numbers that sort by place
    bounded = folded.select("word", "edges", bounds.alias("bounds"))
    placed = F.sort_array(F.transform(F.filter("edges", fits), lambda x: x.bitwiseAND(F.lit((1 << 36) - 1))))
    taken = bounded.select("word", placed.alias("taken"), (F.bit_count("bounds") - 1).alias("symbols"))
    table = F.array(*map(F.lit, byte_ids))

    def as_bytes(i: Column) -> Column:
        code = F.hex(F.encode(F.substring("word", i + 1, F.lit(1)), "UTF-8"))
        numbers = F.transform(
            F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")
        )
        return F.struct(i.alias("s"), F.transform(numbers, lambda b: F.element_at(table, b + 1)).alias("ids"))

    places = F.sequence(F.lit(0), F.char_length("word") - 1)
    bare = F.filter(places, lambda i: ~F.exists("taken", lambda x: (_edge(x)["s"] <= i) & (i < _edge(x)["e"])))
    symbols = F.transform("taken", lambda x: F.struct(_edge(x)["s"].alias("s"), F.array(_edge(x)["id"]).alias("ids")))
    mixed = F.flatten(F.transform(F.array_sort(F.concat(symbols, F.transform(bare, as_bytes))), lambda x: x["ids"]))
    return taken.select("word", F.when(F.size("taken") == F.col("symbols"), F.transform("taken", lambda x: _edge(x)["id"])).otherwise(mixed).alias("ids"))


def _library(pieces: Pieces):
    """Encoding of words by the library, which puts a space mark in front of every text.

    A word without marks is encoded behind a sign that no piece joins to it, whose ids are taken off.
    """
    path, apart = pieces.path, pieces.apart

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        signs = {sign: model.encode(sign) for sign in ("a", apart[:1])}

        def ids(word: str) -> list[int]:
            if word[0] == MARK:
                return model.encode(word.replace(MARK, " ")[1:], num_threads=1)
            sign = "a" if word[0] in apart else apart[:1]
            found, first = model.encode(sign + word, num_threads=1), signs[sign]
            if found[:len(first)] != first:
                raise ValueError(f"a piece joins {sign!r} to {word[:10]!r}")
            return found[len(first):]

        for b in batches:
            yield pd.Series([ids(w) for w in b])

    return encode


#: Words of a partition, whose edges are grouped in memory.
GROUPED = 40_000


def encoded_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Every distinct word of ``docs`` once: ``word, ids``."""
    distinct = materialise(distinct_words(docs, pieces))
    length = F.char_length("word")
    parts = max(1, -(-distinct.count() // GROUPED))
    folded = lattice(distinct.where(length <= LONGEST).repartition(parts, "word"), pieces)
    if pieces.kind == "unigram":
        scores = [-s for s in sorted({-s for _, _, s in pieces.rows})]
        bounds = viterbi(F.col("edges"), length, scores, scores[-1] - 10.0)
    else:
        bounds = merged_in_any_order(F.col("edges"), length, late_pieces(pieces))
    short = path_ids(folded, bounds, pieces.bytes_)
    long = distinct.where(length > LONGEST)
    if pieces.kind == "bpe":
        return short.unionByName(long.select("word", _library(pieces)("word").alias("ids")))
    if not long.isEmpty():
        raise ValueError(f"words of more than {LONGEST} characters need a BPE model")
    return short


@dataclass
class WordTable:
    """Encoded words as sorted hash arrays in slices, in files that workers map."""

    folder: str
    slices: int
    files: dict[int, str]
    wrong: int

    def open(self) -> WordTable:
        types = {"keys": "<u8", "at": "<i8", "bytes": "u1", "ids_at": "<i8", "ids": "<i4"}
        self.parts = {s: {n: mapped_array(f"{self.folder}/{f}.{n}", t) for n, t in types.items()} for s, f in self.files.items()}
        return self

    def look_up(self, wanted: list[str]) -> list[bytes]:
        """Ids of each word as bytes; the words themselves are compared, not only their hashes."""
        import xxhash

        raw = [w.encode() for w in wanted]
        keys = np.array([xxhash.xxh64_intdigest(w, 42) for w in raw], np.uint64)
        order = np.argsort(keys)
        out = [b""] * len(wanted)
        for s, run in _runs(_top(keys[order], self.slices)):
            p, of = self.parts[s], order[run]
            at, _ = _find(p["keys"], keys[of])
            held, ids = memoryview(p["bytes"]), memoryview(p["ids"].view("u1"))
            places = [p["at"][at], p["at"][at + 1], 4 * p["ids_at"][at], 4 * p["ids_at"][at + 1]]
            for i, j, a, b, c, d in zip(of.tolist(), at.tolist(), *(x.tolist() for x in places)):
                out[i] = bytes(ids[c:d]) if bytes(held[a:b]) == raw[i] else self._further(p, j, int(keys[i]), raw[i])
        return out

    @staticmethod
    def _further(p: dict[str, np.ndarray], j: int, key: int, word: bytes) -> bytes:
        """A word whose hash is also that of another one."""
        while j + 1 < len(p["keys"]) and int(p["keys"][j + 1]) == key:
            j += 1
            if p["bytes"][p["at"][j]:p["at"][j + 1]].tobytes() == word:
                return p["ids"][p["ids_at"][j]:p["ids_at"][j + 1]].tobytes()
        raise KeyError(word.decode())


def store_words(encoded: DataFrame, folder: str, pieces: Pieces) -> WordTable:
    slices = _slices(encoded.sparkSession)
    bits = slices.bit_length() - 1
    key = F.xxhash64("word")
    keyed = encoded.select(
        (F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0)).cast("int").alias("slice"), key.alias("key"), F.col("word").cast("binary").alias("word"), "ids"
    )
    schema = "slice int, file string, wrong bigint"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, decode = None, [], Decoder(pieces)

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy().view(np.uint64)
            table, keys = table.take(np.argsort(keys, kind="stable")), np.sort(keys)
            w, ids = table.column("word").to_pylist(), table.column("ids").to_pylist()
            name = f"slice-{now:06d}-{uuid.uuid4().hex}"
            values = {
                "keys": keys.astype("<u8"), "at": np.cumsum([0, *map(len, w)]).astype("<i8"), "bytes": np.frombuffer(b"".join(w), np.uint8),
                "ids_at": np.cumsum([0, *map(len, ids)]).astype("<i8"), "ids": np.array([i for x in ids for i in x], "<i4"),
            }
            for n, v in values.items():
                write_array(f"{folder}/{name}.{n}", v)
            mark = MARK.encode()
            wrong = sum(decode.bytes(i) != x.replace(mark, b" ") for x, i in zip(w, ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([name], pa.string()), pa.array([wrong], pa.int64())], ["slice", "file", "wrong"]
            )

        for b in batches:
            for s, part in _runs(b.column("slice").to_numpy()):
                if s != now:
                    if held:
                        yield flush()
                    now, held = s, []
                held.append(b.slice(part.start, part.stop - part.start))
        if held:
            yield flush()

    # the partitions hold a bounded number of words, so their edges need not be sorted to be grouped
    conf, setting = encoded.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(setting)
    conf.set(setting, str(2 * GROUPED))
    try:
        _shuffled(keyed).mapInArrow(releasing(write), schema).write.parquet(f"{folder}/manifest")
    finally:
        conf.set(setting, before)
    rows = encoded.sparkSession.read.schema(schema).parquet(f"{folder}/manifest").collect()  # one for each slice
    return WordTable(folder, slices, {r.slice: r.file for r in rows}, sum(r.wrong for r in rows))


class Decoder:
    def __init__(self, pieces: Pieces):
        self.surface = {i: p.replace(MARK, " ").encode() for p, i, _ in pieces.rows}
        self.surface.update({i: bytes([b]) for b, i in enumerate(pieces.bytes_)})

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface.get(i, b"") for i in ids])

    def __call__(self, ids: list[int]) -> str:
        """Text of the ids without the space in front that the encoding added."""
        return self.bytes(ids).decode("utf-8", "replace")[1:]


_ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, pieces: Pieces, folder: str | None = None) -> DataFrame:
    """Ids of each row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_tokens, ids, round_trip``.

    One row for each input row, whole texts; equal to the library's own encoding without
    begin and end ids. NULL and empty texts have no ids. ``round_trip`` says that decoding the
    ids gives the text back, with its space marks (U+2581), which the model cannot tell from
    spaces, as spaces. Rows are encoded by their text alone; repeated rows, NULL ids and other
    columns play no part. An empty table gives an empty result.
    """
    table = store_words(encoded_words(docs, pieces), folder or new_folder(docs.sparkSession), pieces)

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, decode, opened, split_text = {}, Decoder(pieces), table.open(), splitter(pieces)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = [t or "" for t in b.column("text").to_pylist()]
                split = list(map(split_text, texts))
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set().union(*split).difference(known))
                known.update(zip(new, opened.look_up(new)))
                ids = [b"".join(map(known.__getitem__, s)) for s in split]
                # if every word of the table comes back, so does every text
                same = [not table.wrong or decode(np.frombuffer(i, "<i4").tolist()) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.diff(ends), pa.int64()), lists, pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(releasing(run_batches), _ENCODED)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` (``ids``) with ``text``; NULL stays NULL and ids of no piece vanish."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(pieces)
        for b in batches:
            yield pd.Series([None if ids is None else decoder(list(ids)) for ids in b], dtype="object")

    return encoded.withColumn("text", text("ids"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), read_model(vocabulary_path("piece_bpe_32k.model")))


SQL = None
