"""Similarity join of documents on word n-grams with a MinHash LSH forest.

Every set of shingles gets a signature of ``TREES`` rows of ``DEPTH`` numbers of ``BITS`` bits.
The rows of one number, sorted, are a prefix trie: sets whose rows share a prefix are neighbours
in the sorted order, and one sort serves every prefix length. The join starts from the
longest prefixes, links what shares one and verifies the links on the shingles themselves.
While links as similar as the least similar one found would be missed too often, it goes on with
the longest prefix that finds enough of them; components that gain no set by it keep what was
verified, only the others are compared again.

The sort is by range over ``(tree, row, set)``, so equal rows may span tasks, and only
neighbours are linked: a group of any size costs as many links as it has members. Pairs
are compared within blocks of bounded size and never leave the task; what leaves are link
counts and one link for each set.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table, text_or_empty
from firnline.llm.rows import one_row_each, releasing, repeated_rows, without_rows
from firnline.llm.shingles import in_slices, mix, multipliers, shingle_sets
from firnline.operators.components import connected_components
from firnline.session import materialise

QUERY = "op10_ngram_join"

SHINGLE, SIMILARITY = 5, "0.8"
TREES, DEPTH, BITS = 64, 10, 6
#: Share of the least similar links that prefixes must find before they stop being shortened, and their least length.
RECALL, LEAST_PREFIX = 0.99999, 4
#: A block holds about so many sets and shingles at most.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1 << 20

#: Parts that the verified rows of a component are dealt to.
SALTS = 32

#: Bits of the hash of a row that are looked up before texts are shuffled: 2^20 broadcast numbers at most.
COARSE_BITS = 20

_BINS = TREES * DEPTH
_borrow: np.ndarray | None = None


def _borrowing() -> np.ndarray:
    """For each bin, the order in which it asks the others for their minimum."""
    global _borrow
    if _borrow is None:
        seeds = mix(np.arange(_BINS * _BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(_BINS, _BINS)
        _borrow = np.argsort(seeds, axis=1, kind="stable").astype(np.uint16)
    return _borrow


def signature(shingles: np.ndarray) -> np.ndarray:
    """``TREES * DEPTH`` numbers of ``BITS`` bits, one for each bin, from sorted hashes.

    One permutation hashing: the upper bits of a hash choose its bin and each bin keeps its
    smallest; empty bins borrow. Two sets agree in a bin with the chance of their similarity.
    """
    bins = ((shingles >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    least = np.zeros(_BINS, np.uint64)
    filled = np.zeros(_BINS, bool)
    least[bins[first]], filled[bins[first]] = shingles[first], True
    order, known = _borrowing(), filled.copy()
    for upto in (16, _BINS):
        empty = np.flatnonzero(~known)
        if not len(empty):
            break
        asked = order[empty, :upto]
        gives = filled[asked]
        has = gives.any(axis=1)
        least[empty[has]] = least[asked[has, gives[has].argmax(axis=1)]]
        known[empty[has]] = True
    with np.errstate(over="ignore"):
        return (mix(least + np.arange(_BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint8)


def trie_rows(signed: np.ndarray) -> np.ndarray:
    """The signature as one number for each tree, the first of its ``DEPTH`` parts uppermost."""
    return signed.reshape(TREES, DEPTH).astype(np.int64) @ (np.int64(1) << np.arange(DEPTH - 1, -1, -1) * BITS)


def set_key(shingles: np.ndarray, factor: np.uint64) -> np.int64:
    """A number for a whole set."""
    with np.errstate(over="ignore"):
        return mix(shingles + factor).sum(dtype=np.uint64).astype(np.int64)


_SIGNED = "doc_id bigint, th bigint, n int, k1 bigint, k2 bigint, rows array<bigint>"


@releasing
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor = multipliers(2, seed=11)
    for b in (part for whole in batches for part in in_slices(whole, most_bytes=1 << 20)):
        sets = shingle_sets(b.column("text"), SHINGLE)
        keys = [[set_key(s, f) for s in sets] for f in factor]
        rows = [trie_rows(signature(s)) if len(s) else None for s in sets]
        flat = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int64)])
        ends = np.cumsum([0] + [0 if r is None else TREES for r in rows]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int32()),
             pa.array(np.array(keys[0], np.int64)), pa.array(np.array(keys[1], np.int64)),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["doc_id", "th", "n", "k1", "k2", "rows"],
        )


_LINKS = "a bigint, b bigint, shared int, part int, tree int, row bigint"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows ``(part, tree, row, k1)``: equal rows to the first of them, unequal ones to the next.

    The first and the last row of the part come out too (``shared`` is NULL), to be linked across parts.
    """
    last, ends = None, []
    for b in batches:
        if not b.num_rows:
            continue
        tree, row, k1 = (b.column(c).to_numpy() for c in ("tree", "row", "k1"))
        part = b.column("part")[0].as_py()
        if last is None:
            ends.append((part, int(tree[0]), int(row[0]), int(k1[0])))
        else:
            tree, row, k1 = (np.append(x, y) for x, y in zip(last, (tree, row, k1)))
        new = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (row[1:] != row[:-1])))
        heads = np.repeat(k1[new], np.diff(np.append(new, len(k1))))
        differs = row[new[1:]] ^ row[new[:-1]]
        # zero parts at the top of what differs
        shared = sum((differs >> BITS * j == 0).astype(np.int32) for j in range(DEPTH))
        near = (tree[new[1:]] == tree[new[:-1]]) & (shared >= LEAST_PREFIX)
        a = np.concatenate([heads, k1[new[:-1]][near]])
        c = np.concatenate([k1, k1[new[1:]][near]])
        depth = np.concatenate([np.full(len(k1), DEPTH), shared[near]])
        real = a != c
        yield _links(a[real], c[real], depth[real])
        last = [tree[new[-1]:][:1], row[new[-1]:][:1], k1[new[-1]:][:1]]
        end = (part, int(tree[-1]), int(row[-1]), int(k1[-1]))
    if ends:
        ends.append(end)
        none = pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[3] for e in ends], pa.int64()), none[0], none[1], pa.array([e[0] for e in ends], pa.int32()),
             pa.array([e[1] for e in ends], pa.int32()), pa.array([e[2] for e in ends], pa.int64())],
            ["a", "b", "shared", "part", "tree", "row"],
        )


def _links(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
        ["a", "b", "shared", "part", "tree", "row"],
    )


def forest_links(signed: DataFrame) -> DataFrame:
    """Neighbours in the sorted tries: ``a, b, shared`` with the length of the longest prefix that they share."""
    spark = signed.sparkSession
    rows = signed.where("n > 0").select("k1", F.posexplode("rows").alias("tree", "row"))
    order = ["tree", "row", "k1"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = materialise(placed.select("part", *order).mapInArrow(_neighbours, _LINKS))
    # two rows for each part of the sort; consecutive parts meet at their ends
    ends = sorted(found.where("shared IS NULL").select("part", "tree", "row", "a").collect())
    across = []
    for x, y in zip(ends[1::2], ends[2::2]):
        shared = DEPTH - ((x.row ^ y.row).bit_length() + BITS - 1) // BITS
        if x.tree == y.tree and x.a != y.a and shared >= LEAST_PREFIX:
            across.append((x.a, y.a, shared))
    joined = found.where("shared IS NOT NULL").select("a", "b", "shared")
    if across:
        joined = joined.unionByName(spark.createDataFrame(across, "a bigint, b bigint, shared int"))
    return joined.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))


_VERIFIED = "component bigint, k1 bigint, root bigint, links bigint, bin int, pairs bigint"


@releasing
def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each set; of rows of the same id and text, which the join brings to the same task, one is enough."""
    seen: set[int] = set()
    factor = multipliers(2, seed=11)[0]
    for b in batches:
        b = b.take(pa.array([i for i, k in enumerate(b.column("k1").to_pylist()) if k not in seen], pa.int64()))
        sets, first = shingle_sets(b.column("text"), SHINGLE), []
        for i, (k, s) in enumerate(zip(b.column("k1").to_pylist(), sets)):
            # another row with the same hash has another set
            if k not in seen and set_key(s, factor) == k:
                seen.add(k)
                first.append(i)
        b, sets = b.take(pa.array(first, pa.int64())), [sets[i] for i in first]
        keep = [b.column(c) for c in ("component", "k1", "block", "blocks")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array([s.tobytes() for s in sets], pa.binary())], ["component", "k1", "block", "blocks", "shingles"]
        )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of sorted distinct hashes."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    sizes = [len(s) for s in left + right]
    values, column = np.unique(np.concatenate(left + right), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    row = np.repeat(np.arange(len(sizes)), sizes)[often[column]]
    column = (np.cumsum(often) - 1)[column[often[column]]]
    total = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, (1 << 22) // len(sizes))
    for start in range(0, int(often.sum()), width):
        part = slice(*np.searchsorted(column, [start, start + width]))
        dense = np.zeros((len(sizes), width), np.float32)
        dense[row[part], column[part] - start] = 1.0
        total += (dense[:len(left)] @ dense[len(left):].T).astype(np.int64)
    return total


def compare(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs reach the threshold, exactly, and the similarity of all."""
    inter = overlaps(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
    return inter * threshold.denominator >= union * threshold.numerator, inter / union


def _roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``a`` and ``b``, the smallest key that it reaches through the links."""
    top = np.iinfo(np.int64).max
    left, right = a.copy(), b.copy()
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], top).min(axis=1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return np.concatenate([left, right])
        left, right = new_left, new_right


def _verifier(threshold: Fraction):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        key, rows = None, {}
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("component", "i", "j", "block", "k1", "shingles")]
            for component, i, j, block, k1, s in zip(*columns):
                if (component, i, j) != key:
                    if rows:
                        yield key, rows
                    key, rows = (component, i, j), {}
                rows[k1] = block, np.frombuffer(s, np.uint64)
        if rows:
            yield key, rows

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Counter = Counter()
        out: list[tuple[int, int, int, int]] = []
        for (component, i, j), rows in groups(batches):
            left = {k: s for k, (block, s) in rows.items() if block == i}
            right = left if i == j else {k: s for k, (block, s) in rows.items() if block == j}
            if not left or not right or (i == j and len(left) == 1):
                continue
            a, b = (np.array(list(x), np.int64) for x in (left, right))
            linked, how = compare(list(left.values()), list(right.values()), threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            binned, n = np.unique((how[linked] * 100).astype(int), return_counts=True)
            bins.update({(component, s): k for s, k in zip(binned.tolist(), (n if i != j else n // 2 + n % 2).tolist())})
            roots = _roots(linked, a, b)
            for x, root, n in ((a, roots[:len(a)], linked.sum(axis=1)), (b, roots[len(a):], linked.sum(axis=0)))[:1 if i == j else 2]:
                some = n > 0
                out.extend((component, *row) for row in zip(x[some].tolist(), root[some].tolist(), n[some].tolist()))
            if len(out) + len(bins) > 100_000:
                yield _verified(out, bins)
                out, bins = [], Counter()
        yield _verified(out, bins)

    return verify


def _verified(rows: list[tuple[int, int, int, int]], bins: Counter) -> pa.RecordBatch:
    component, k1, root, links = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    pad, none = [None] * len(bins), [None] * len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(component + [c for c, _ in bins], pa.int64()),
         pa.array(k1 + pad, pa.int64()), pa.array(root + pad, pa.int64()), pa.array(links + pad, pa.int64()),
         pa.array(none + [s for _, s in bins], pa.int32()), pa.array(none + list(bins.values()), pa.int64())],
        ["component", "k1", "root", "links", "bin", "pairs"],
    )


def _members(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets that have links, with the least key of each candidate component."""
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    components = connected_components(links, ends).select(F.col("v").alias("k1"), "component")
    return materialise(components.join(sets.select("k1", "rk", "n"), "k1"))


def _verify(docs: DataFrame, members: DataFrame, sized: DataFrame, threshold: Fraction) -> DataFrame:
    """Compare all pairs within each component of ``sized``: link counts, one link for each set, similarities."""
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    wanted = members.join(sized.select("component", blocks.alias("blocks")), "component").select(
        "rk", "component", "k1", "blocks", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int").alias("block")
    )
    texts = docs.select(_row_key(F.xxhash64(text_or_empty())).alias("rk"), text_or_empty().alias("text"))
    # a table of a fixed number of bits of the hash, at most, keeps most other texts out of the shuffle
    coarse = F.col("rk").bitwiseAND(F.lit((1 << COARSE_BITS) - 1))
    near = materialise(wanted.select(coarse.alias("coarse")).distinct())
    texts = texts.withColumn("coarse", coarse).join(F.broadcast(near), "coarse", "left_semi")
    met = texts.join(wanted, "rk").select("component", "k1", "block", "blocks", "text")
    shingled = met.mapInArrow(_shingled, "component bigint, k1 bigint, block int, blocks int, shingles binary")
    # each pair of blocks of a component meets in one group
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grouped = shingled.withColumn("other", other).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k1", "shingles"
    )
    keys = ["component", "i", "j"]
    return materialise(grouped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(_verifier(threshold)), _VERIFIED))


def _row_key(th: Column) -> Column:
    """A hash of the id and the text of a row, so copies of a text do not meet by it."""
    return F.xxhash64("doc_id", th)


def expected_recall(similarities: dict[int, int], prefix: int) -> float:
    """Share of the least similar links that prefixes of this length find; links are counted by hundredths of similarity."""
    return 1 - (1 - (min(similarities) / 100) ** prefix) ** TREES if similarities else 1.0


def next_prefix(similarities: dict[int, int], prefix: int, recall: float) -> int | None:
    """The longest shorter prefix that finds enough, the least one if none does, or None where ``prefix`` does."""
    if prefix <= LEAST_PREFIX or expected_recall(similarities, prefix) >= recall:
        return None
    return next((p for p in range(prefix - 1, LEAST_PREFIX, -1) if expected_recall(similarities, p) >= recall), LEAST_PREFIX)


def similar_documents(docs: DataFrame, threshold: str = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Classes and link counts of the rows of ``docs`` (``doc_id``, ``text``).

    Returns one row for each input row: ``doc_id, class_id, n_links, copy_id, n_copies``.
    Two documents are linked when the Jaccard similarity of their sets of five-word shingles is
    ``threshold`` or more. ``class_id`` is the smallest id of those joined by links, ``copy_id``
    the smallest id with the same set of shingles, ``n_copies`` their number and ``n_links`` the
    number of other such sets that are linked to this one.

    A text of fewer than five words, but not none, is one shingle. NULL and empty texts and
    texts without words are linked to nothing and are classes of their own. Ids only name rows:
    rows that repeat an id are rows of their own, and a NULL id is only returned where no row of
    the class has another. An empty table gives an empty result. Other columns are not read.
    """
    return _classes(docs, threshold, recall).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def _classes(docs: DataFrame, threshold: str, recall: float) -> DataFrame:
    """``similar_documents`` with the hash of each text, ``th``, and a key of each class, NULL for texts without words."""
    limit = Fraction(threshold)
    signed = materialise(docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text")).mapInArrow(_sign, _SIGNED))
    sets = materialise(signed.where("n > 0").groupBy("k1").agg(
        F.min(_row_key(F.col("th"))).alias("rk"), F.min("n").alias("n"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"),
        F.min("k2").alias("k2"), F.max("k2").alias("other_k2"),
    ))
    if not sets.where("k2 != other_k2").isEmpty():
        raise RuntimeError("two sets of shingles have the same 64-bit key")
    links = materialise(forest_links(signed))
    verified = before = None
    prefix = DEPTH
    while prefix is not None:
        members = _members(sets, links.where(F.col("shared") >= prefix).select("a", "b"))
        sized = materialise(members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")))
        if verified is None:
            verified = _verify(docs, members, sized, limit)
        else:
            # shorter prefixes only add links, so a component of the same least key and size is the same
            same = ["component", "m"]
            stays = sized.join(before, same, "left_semi").select("component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            salt = F.pmod(F.xxhash64("k1", "bin"), F.lit(SALTS)).cast("int").alias("salt")
            known = verified.select("*", salt).join(stays, ["component", "salt"], "left_semi").drop("salt").select(*verified.columns)
            verified = materialise(known.unionByName(_verify(docs, members, sized.join(before, same, "left_anti"), limit)))
        before = sized.select("component", "m")
        seen = verified.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("pairs").alias("n")).collect()
        prefix = next_prefix({r.bin: r.n for r in seen}, prefix, recall)

    linked = verified.where("k1 IS NOT NULL").groupBy("k1").agg(F.sum("links").alias("n_links"))
    edges = verified.where("k1 IS NOT NULL").select(F.col("k1").alias("a"), F.col("root").alias("b")).distinct()
    roots = connected_components(edges, sets.select(F.col("k1").alias("v"))).select(F.col("v").alias("k1"), "component")
    known = materialise(sets.select("k1", "copy_id", "n_copies").join(roots, "k1").join(linked, "k1", "left"))
    classes = known.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    labelled = known.join(classes, "component").select("k1", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copy_id", "n_copies", "component")
    rows = signed.select("doc_id", "th", F.when(F.col("n") > 0, F.col("k1")).alias("k1"))
    # texts without words have no key to join on
    with_words = rows.where("k1 IS NOT NULL").join(labelled, "k1").select("doc_id", "class_id", "n_links", "copy_id", "n_copies", "th", "component")
    without = rows.where("k1 IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.col("doc_id").alias("copy_id"), F.lit(1).cast("bigint").alias("n_copies"), "th", F.lit(None).cast("bigint").alias("component"),
    )
    return with_words.unionByName(without)


def without_near_duplicates(docs: DataFrame, threshold: str = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class, one of the smallest id; all columns stay. See ``similar_documents``.

    Rows go by id and text together. Texts without words all stay.
    """
    rows = materialise(_classes(docs, threshold, recall).where("component IS NOT NULL").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_key"), "component", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("first")
    ))
    # one text of those that share the smallest id of their class
    stays = rows.where("first").groupBy(F.col("component").alias("c")).agg(F.min("_key").alias("text"))
    kept = F.col("first") & (F.col("_key") == F.col("text"))
    rows = materialise(rows.join(stays, F.col("component") == F.col("c")).select("_id", "_key", kept.alias("kept")))
    losers = materialise(rows.where(~F.col("kept")).select("_id", "_key").distinct())
    key = lambda: F.xxhash64(text_or_empty())
    return one_row_each(without_rows(docs, losers, key), repeated_rows(rows.where("kept")), key)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))


SQL = None
