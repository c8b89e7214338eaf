"""Spelling variants by asymmetric chunks.

One word of a pair contributes two disjoint chunks, its halves; the other, which is as long
or one longer, contributes the positional grams of the same length. One edit leaves one of
the chunks whole, and there it moves by at most the difference in length, so words meet on
``(length, chunk number, gram)`` with the gram within shift one of the chunk's place.

Short halves are weak keys: a third of all words may share one. The rest of a word beside a
preserved chunk is again a word with one edit, so the rule is applied to it once more, and the
key holds the chunk and the preserved half of the rest. What words of one key do not share is
a quarter of their length. Pairs are verified by their edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import lower_ascii, read_table, text_or_empty
from firnline.session import materialise

QUERY = "op12_spelling_variants"

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: How often the rule is applied.
LEVELS = 2


def _without(word: Column, at: Column) -> Column:
    """The word without the character at a place counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def misspelt(doc_id: Column, word: Column, one_in: int) -> Column:
    """The word as it is, or in one of ``one_in`` cases without one character, both chosen by a hash of id and word."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word)
    h = F.crc32(named.cast("binary"))
    return F.when(h % one_in == 0, _without(word, (h % F.char_length(word)).cast("int"))).otherwise(word)


def word_counts(docs: DataFrame, one_in: int | None = 31, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Words of ``docs`` and how often they occur: ``word, n``.

    Words are maximal runs of Latin letters, A-Z lower-cased, of ``least_length`` characters or
    more that occur ``least_count`` times or more. With ``one_in``, one in so many loses a character.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_or_empty(), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    words = runs.select("doc_id", lower_ascii(F.col("run")).alias("word"))
    if one_in:
        words = words.select(misspelt(F.col("doc_id"), F.col("word"), one_in).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _regions(length: Column, levels: int) -> list[tuple[int, Column, Column]]:
    """Where the edit may be once ``levels`` chunks are known to be whole: ``(number, first, end)`` for each choice of chunks."""
    found = [(1, F.lit(0), length)]
    for _ in range(levels):
        split = []
        for number, a, b in found:
            middle = F.floor((a + b) / 2).cast("int")
            split += [(2 * number, middle, b), (2 * number + 1, a, middle)]
        found = split
    return found


def _keys(word: Column, length: Column, longer: int, levels: int) -> Column:
    """Keys of a word against words of ``length`` characters, fewer than its own by ``longer``.

    A key is the text around the region of the edit, which starts at the same place in both words
    and is longer by ``longer`` in this one: what stands behind it is shifted by as much.
    """
    return F.array(*[
        F.xxhash64(length, F.lit(number), F.substring(word, F.lit(1), a), F.substring(word, b + (1 + longer), length))
        for number, a, b in _regions(length, levels)
    ])


def near_pairs(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Pairs of ``words`` (``word, n``) that differ by one inserted, deleted or replaced character, once each.

    Returns ``a, n_a, b, n_b`` with ``a`` shorter than ``b``, or first of those of one length.
    """
    length = F.char_length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys(F.col("word"), length, 0, levels)).alias("key"))
    same = F.explode(F.concat(_keys(F.col("word"), length, 0, levels), _keys(F.col("word"), length - 1, 1, levels)))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), same.alias("key"))
    a, b = F.col("a"), F.col("b")
    one_edit = (F.char_length(a) < F.char_length(b)) | (a < b)
    met = chunks.join(grams, "key").where(one_edit & (F.levenshtein(a, b, 1) == 1))
    # an edit within a run of equal characters has several places
    return met.select("a", "n_a", "b", "n_b").distinct()


def spelling_variants(words: DataFrame, ratio: int = RATIO, levels: int = LEVELS) -> DataFrame:
    """Variants among ``words`` (``word, n``): ``word, form, root, n, n_near, form_n``, one row for each word.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them, the first in
    code-point order of those equally frequent, if it is ``ratio`` times as frequent as the word,
    else NULL. ``root`` is where the forms of forms end, the word itself if it has no form. NULL and
    repeated words must not occur; ``word_counts`` gives none. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    pairs = materialise(near_pairs(words, levels))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("best")
    )
    often = -F.col("best.order") >= F.col("n") * ratio
    formed = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.order")).alias("form_n"),
    ))
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), formed, ratio)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame, words: DataFrame, ratio: int) -> DataFrame:
    """Where the chains of forms end, by pointer doubling: ``word, root``.

    Each step of a chain multiplies the frequency, so the frequencies bound the number of rounds.
    """
    bounds = words.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    reach, longest = 1, 0
    while bounds.least and bounds.least * ratio ** (longest + 1) <= bounds.most:
        longest += 1
    current = forms
    while reach < longest:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        current = materialise(current.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
        reach *= 2
    return current


def variants_of_documents(docs: DataFrame, one_in: int | None = 31) -> DataFrame:
    """Spelling variants among the words of ``docs`` (``doc_id``, ``text``), see ``word_counts`` and ``spelling_variants``.

    NULL and empty texts have no words; a NULL ``doc_id`` is hashed as no characters. Rows that
    repeat count as often as they occur. Other columns are not read.
    """
    return spelling_variants(materialise(word_counts(docs, one_in)))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_of_documents(read_table(spark, sf_dir, "documents"))


SQL = None
