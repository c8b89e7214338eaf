"""Near duplicates from similarity sketches that are filled by rounds of hashed bin placement.

A sketch has ``BINS`` coordinates. In round ``i`` every shingle of a set is hashed anew to a
bin and a value between ``i`` and ``i + 1``, and each bin keeps its smallest value. The rounds
end once no bin is empty; from round ``BINS`` on, a round puts all shingles into one bin, so
that every coordinate fills, of sets of one shingle too. Two sets agree in a coordinate with
the chance of their Jaccard similarity, and the agreeing share is concentrated around it as if
the coordinates were independent, which is what banding relies on: 32 bands of six coordinates
miss a pair at the threshold of 0.85 with a chance of three in ten million.

Equal sets are one vertex. Sets that share a band meet in a bucket, in two steps:

1. Each bucket is a star. Its first set is compared with all others, exactly, on the whole sets.
   What this links falls into components.
2. Buckets that still hold several components are compared further: every set outside the
   largest component of its bucket with all sets of other components. A pair is compared in the
   first band that it shares, and not at all once links of the same task connect it.

So a group of near copies of any size costs a comparison for each member, and no pair leaves a
task, only the links that connect something. Stars and buckets of any size are split between
tasks: one side is held, at most ``HELD_SETS`` sets and about ``HELD_SHINGLES`` shingles of it,
and the other streams past.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table, text_or_empty
from firnline.llm.shingles import in_slices, mix, multipliers, word_hashes
from firnline.operators.components import connected_components
from firnline.session import materialise

QUERY = "op13_sketch_dedup"

SHINGLE, SIMILARITY = 3, "0.85"
BANDS, WIDTH = 32, 6
BINS = BANDS * WIDTH

#: Sets and shingles that a task holds at once, and sets that stream past them.
HELD_SETS, HELD_SHINGLES, STREAMED_SETS = 256, 1 << 20, 2000
#: Sets with at least one row in so many of all rows are so many at most, and are joined by broadcast.
FREQUENT = 10_000
#: Bytes of text that are hashed at once.
SLICE = 2 << 20

#: Everything but ASCII white space makes words.
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of every text, one after the other, and where each text begins.

    A text of fewer than ``width`` words, but not none, is one shingle.
    """
    words, bounds = word_hashes(texts, _NOT_SPACE)
    factors = multipliers(width, seed=23)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += words[j:j + n] * factors[j]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                sets.append(np.unique(rolled[a:b - width + 1]))
            else:
                sets.append(mix(np.array([np.sum(words[a:b] * factors[:b - a]) + np.uint64(b - a)], np.uint64)) if b > a else words[:0])
    return np.concatenate([*sets, words[:0]]), np.cumsum([0, *map(len, sets)])


def sketches(shingles: np.ndarray, starts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of each set, one row of ``bins`` numbers for each; sets without shingles keep empty rows of zeros.

    A number holds the round in its upper half and the value within the round in its lower half.
    """
    n = len(starts) - 1
    none = np.uint64(2**64 - 1)
    least = np.full(n * bins, none)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * bins):
        with np.errstate(over="ignore"):
            h = mix(shingles ^ (_GOLDEN * np.uint64(2 * i + 1)))
        if i < bins:
            place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            place = i - bins
        np.minimum.at(least, owner * bins + place, (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        # only sets with empty bins go on
        open_sets = np.unique(owner)
        unfilled = open_sets[(least.reshape(n, bins)[open_sets] == none).any(axis=1)]
        if not len(unfilled):
            break
        if len(unfilled) < len(open_sets):
            keep = np.isin(owner, unfilled)
            owner, shingles = owner[keep], shingles[keep]
    least[least == none] = 0
    return least.reshape(n, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS, width: int = WIDTH) -> np.ndarray:
    """One 64-bit number for each band of each sketch; the number of the band is part of it."""
    with np.errstate(over="ignore"):
        parts = mix(sketch.reshape(-1, bands, width) * multipliers(width, seed=31)[None, None, :])
        total = (parts * multipliers(width, seed=37)[None, None, :]).sum(axis=2, dtype=np.uint64)
        return mix(total + _GOLDEN * np.arange(1, bands + 1, dtype=np.uint64)[None, :]).view(np.int64)


def _set_keys(shingles: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set, 128 bits that name it."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + f), dtype=np.uint64)]) for f in multipliers(2, seed=41)]
        return [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]


_SIGNED = "doc_id bigint, th bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in in_slices(whole, most_bytes=SLICE)):
        shingles, starts = shingle_sets(b.column("text"))
        k1, k2 = _set_keys(shingles, starts)
        keys = band_keys(sketches(shingles, starts))
        has = np.diff(starts) > 0
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, has * BANDS)), pa.int32()), pa.array(keys[has].ravel()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(np.diff(starts), pa.int64()), pa.array(k1), pa.array(k2), lists],
            ["doc_id", "th", "n", "k1", "k2", "bands"],
        )


def distinct_sets(signed: DataFrame) -> DataFrame:
    """Every set once, numbered: ``set, k1, k2, n, bands``, its smallest id, its rows, and one row whose text has it."""
    sets = signed.where("n > 0").groupBy("k1", "k2").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("doc_id", "th")).alias("row"), F.any_value("bands").alias("bands"),
    )
    # numbers are unique whichever attempt of a task wrote them, and are read from the written table only
    return materialise(sets.withColumn("set", F.monotonically_increasing_id()))


def _row_key(doc_id, th):
    return F.xxhash64(doc_id, th)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in in_slices(whole, most_bytes=SLICE)):
        shingles, starts = shingle_sets(b.column("text"))
        k1, k2 = _set_keys(shingles, starts)
        # a text of another set has the same hash by chance
        same = np.flatnonzero((k1 == b.column("k1").to_numpy()) & (k2 == b.column("k2").to_numpy()))
        sets = [shingles[starts[i]:starts[i + 1]].tobytes() for i in same.tolist()]
        yield pa.RecordBatch.from_arrays([b.column("set").take(pa.array(same)), pa.array(sets, pa.binary())], ["set", "shingles"])


def shingles_of(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Shingles of each of ``sets``, from one row of ``docs`` for each: ``set, shingles``."""
    wanted = sets.select("set", "k1", "k2", _row_key(F.col("row.doc_id"), F.col("row.th")).alias("rk"))
    texts = docs.select(_row_key(F.col("doc_id"), F.xxhash64(text_or_empty())).alias("rk"), text_or_empty().alias("text"))
    found = texts.join(wanted, "rk").mapInArrow(_shingled, "set bigint, shingles binary")
    # rows that repeat both id and text
    return materialise(found.groupBy("set").agg(F.any_value("shingles").alias("shingles")))


class _Union:
    """Components among the numbers seen so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(x, x)) != root:
            self.up[x], x = root, above
        return root

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class _Held:
    """Sets that others are compared with, as one sorted index."""

    def __init__(self, rows: list[tuple]):
        self.sets, self.components, self.outside, bands, shingles = zip(*rows)
        self.bands = np.stack(bands)
        self.sizes = np.array([len(s) for s in shingles])
        values = np.concatenate(shingles)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(rows)), self.sizes)[order]

    def overlap(self, shingles: np.ndarray) -> np.ndarray:
        """Size of the intersection with each held set."""
        a, b = (np.searchsorted(self.values, shingles, side) for side in ("left", "right"))
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


_LINKS = "a bigint, b bigint"


def comparer(threshold: Fraction, first_band_only: bool):
    """Links among groups of rows sorted by group: the held rows (``role`` 0) come first and the others stream past."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held, union = None, [], None, _Union()
        for b in batches:
            a_side, b_side = [], []
            names = ("group", "i", "j", "role", "set", "component", "outside", "bands", "shingles")
            for g, i, j, role, s, component, outside, bands, raw in zip(*(b.column(c).to_pylist() for c in names)):
                if (g, i, j) != group:
                    group, rows, held, union = (g, i, j), [], None, _Union()
                shingles, keys = np.frombuffer(raw, np.uint64), np.array(bands, np.int64)
                if role == 0:
                    rows.append((s, component, outside, keys, shingles))
                    continue
                if held is None:
                    if not rows:
                        continue
                    held, rows = _Held(rows), []
                mine = union.find(component)
                open_ = np.array([union.find(c) != mine and not (outside and o and t >= s) for t, c, o in zip(held.sets, held.components, held.outside)])
                if first_band_only:
                    common = held.bands == keys[None, :]
                    open_ &= keys[common.argmax(axis=1)] == g
                if not open_.any():
                    continue
                both = held.overlap(shingles)
                union_size = held.sizes + len(shingles) - both
                for k in np.flatnonzero(open_ & (both * threshold.denominator >= union_size * threshold.numerator)).tolist():
                    if union.link(held.components[k], component):
                        a_side.append(held.sets[k])
                        b_side.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.int64()), pa.array(b_side, pa.int64())], ["a", "b"])

    return compare


def _compared(held: DataFrame, streamed: DataFrame, known: DataFrame, threshold: Fraction, first_band_only: bool) -> DataFrame:
    """Links between ``held`` and ``streamed`` rows (``group, set, component, outside``) of the same group.

    Both sides of a group are cut into parts, the held one by its sets and shingles, and every part of
    one meets every part of the other.
    """
    def parts(side: DataFrame, name: str, size) -> DataFrame:
        return side.groupBy("group").agg(size.cast("int").alias(name))

    ns = parts(held, "ni", F.greatest(F.ceil(F.count(F.lit(1)) / HELD_SETS), F.ceil(F.sum("n") / HELD_SHINGLES)))
    ms = parts(streamed, "nj", F.ceil(F.count(F.lit(1)) / STREAMED_SETS))
    counts = materialise(ns.join(ms, "group"))

    def dealt(side: DataFrame, role: int, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        return side.join(counts, "group").select(
            "group", "set", "component", "outside", F.pmod(F.xxhash64("set"), F.col(n_own)).cast("int").alias(own), every.alias(other),
            F.lit(role).alias("role"),
        )

    dealt_rows = dealt(held, 0, "i", "j", "ni", "nj").unionByName(dealt(streamed, 1, "j", "i", "nj", "ni"))
    keys = ["group", "i", "j"]
    rows = dealt_rows.join(known, "set").select(*keys, "role", "set", "component", "outside", "bands", "shingles")
    return materialise(
        rows.repartition(*keys).sortWithinPartitions(*keys, "role", "set").mapInArrow(comparer(threshold, first_band_only), _LINKS)
    )


def linked_sets(docs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links ``a, b`` between sets that connect exactly those reachable through similar pairs that share a band."""
    rows = sets.select("set", F.explode("bands").alias("group"))
    shared = rows.groupBy("group").agg(F.min("set").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = materialise(rows.join(shared.select("group", "centre"), "group"))
    known = shingles_of(docs, sets.join(buckets.select("set").distinct(), "set", "left_semi"))
    known = materialise(known.join(sets.select("set", "bands", "n"), "set"))
    sizes = known.select("set", "n")
    of_set = known.select("set", "bands", "shingles")

    # a set meets the same centre in many bands, and once here
    stars = materialise(buckets.where("set != centre").select(F.col("centre").alias("group"), "set").distinct())
    alone = [F.col("set").alias("component"), F.lit(False).alias("outside")]
    centres = stars.select("group").distinct().withColumn("set", F.col("group")).join(sizes, "set").select("group", "set", "n", *alone)
    links = _compared(centres, stars.select("group", "set", *alone), of_set, threshold, False)

    labels = materialise(connected_components(links, sizes.select(F.col("set").alias("v"))).withColumnRenamed("v", "set"))
    placed = materialise(buckets.select("group", "set").join(labels, "set"))
    each = placed.groupBy("group", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = each.groupBy("group").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count(F.lit(1)).alias("c"))
    several = placed.join(largest.where("c > 1").select("group", "largest"), "group").withColumn("outside", F.col("component") != F.col("largest"))
    several = materialise(several.drop("largest"))
    outside = several.where("outside").join(sizes, "set").select("group", "set", "n", "component", "outside")
    more = _compared(outside, several, of_set, threshold, True)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, threshold: str = SIMILARITY) -> DataFrame:
    """Components of the rows of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when the Jaccard similarity of their sets of three-word shingles is
    ``threshold`` or more; words are runs of anything but ASCII white space, A-Z lower-cased.
    ``component_id`` is the smallest id that links reach, ``kept`` marks the document of that id.

    One row for each input row. A text of fewer than three words, but not none, is one shingle.
    NULL and empty texts and texts without words have no shingles and are linked with nothing.
    Rows that repeat an id are rows of their own; a NULL id is returned only where no row of the
    component has another. An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    signed = materialise(texts.mapInArrow(_sign, _SIGNED))
    sets = distinct_sets(signed)
    links = linked_sets(docs, sets, Fraction(threshold))
    labels = connected_components(links, sets.select(F.col("set").alias("v"))).select(F.col("v").alias("set"), "component")
    known = materialise(sets.select("set", "k1", "k2", "first_id", "copies").join(labels, "set"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialise(known.join(least, "component").select("k1", "k2", "copies", "component_id"))

    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    share = max(1, signed.count() // FREQUENT)
    often = F.broadcast(named.where(F.col("copies") > share).select("k1", "k2", F.col("component_id").alias("common"), F.lit(True).alias("met")))
    split = rows.where("n_shingles > 0").join(often, ["k1", "k2"], "left")
    common = split.where("met").select("doc_id", "n_shingles", F.col("common").alias("component_id"))
    rest = split.where("met IS NULL").join(named.where(F.col("copies") <= share), ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    wordless = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = common.unionByName(rest).unionByName(wordless)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


SQL = None
