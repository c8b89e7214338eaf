"""Language identification by compression.

A text is compressed with zstandard once for each language, against a raw-content
dictionary of that language, and belongs to the language with the smallest result. Texts
are reduced to lower-case letters first, and are cut into windows that are compressed one
by one, so that the dictionary helps along the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import crc_mod, read_table

QUERY = "op7_language_id"

#: The dictionary of a language is made of at most so many sampled texts, so much of each, and so many bytes.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 128, 1000, 60_000
#: Languages are a label set; more are taken for an error in the labels.
MOST_LANGUAGES = 500
WINDOW, LEVEL = 2000, 6
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower-case words of letters, or nothing if there is no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return words if any(map(str.isalpha, words)) else ""


def learn(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """Dictionaries from ``labelled`` (``doc_id, text, lang``), the most frequent language first.

    The sample is the texts with the smallest hash of their id in each of ``SAMPLE_TEXTS`` slots
    of each language; it is found without moving texts and without gathering a language in a task.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    chosen = usable.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_TEXTS)).alias("slot")).agg(
        F.min(F.struct(order.alias("order"), F.col("doc_id"))).alias("c"), F.count(F.lit(1)).alias("n")
    ).select("lang", "c.doc_id", "n")
    rows = chosen.limit(MOST_LANGUAGES * SAMPLE_TEXTS + 1).collect()
    languages = {r.lang for r in rows}
    if len(languages) > MOST_LANGUAGES or len(rows) > MOST_LANGUAGES * SAMPLE_TEXTS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return []
    counts = {lang: sum(r.n for r in rows if r.lang == lang) for lang in languages}
    picked = labelled.sparkSession.createDataFrame([(r.lang, r.doc_id) for r in rows], "lang string, doc_id bigint")
    # rows that repeat an id give one text, so the driver sees no more than the slots
    texts = usable.join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("t"))
    sample: dict[str, list[tuple[int, str]]] = {lang: [] for lang in languages}
    for r in texts.collect():
        sample[r.lang].append((r.doc_id, r.t))
    ranked = sorted(languages, key=lambda lang: (-counts[lang], lang))
    made = [(lang, " ".join(letters_only(t) for _, t in sorted(sample[lang])).encode()[-DICTIONARY_BYTES:]) for lang in ranked]
    return [(lang, content) for lang, content in made if len(content) >= 8]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard

        self.languages = [lang for lang, _ in dictionaries]
        self.compressors = []
        for _, content in dictionaries:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False
            ))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and the share by which it beats the next one."""
        body = letters_only(text or "").encode()
        if not body or not self.languages:
            return UNKNOWN, 0.0
        windows = [body[i:i + WINDOW] for i in range(0, len(body), WINDOW)]
        sizes = [sum(len(c.compress(w)) for w in windows) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1:]
        second = min(rest) if rest else max(sizes[best], len(body))
        return self.languages[best], (second - sizes[best]) / second


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], held_out: Column, min_margin: float = 0.01) -> DataFrame:
    """Language of each row of ``docs``: ``doc_id, held_out, lang_pred, score, rejected``.

    One row for each input row. ``score`` is the share of the compressed size by which the
    language beats the next one, and ``rejected`` says that it is under ``min_margin``. Texts
    that are NULL, empty or without a letter are ``und`` with score 0 and rejected. Equal sizes
    go to the language with more training rows, then to the smaller name. Without any
    dictionary every text is ``und``. Ids, labels and other columns take no part.
    """
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for b in batches:
            found = [classify(t) for t in b.column("text").to_pylist()]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            rejected = pa.array([s < min_margin for _, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), langs, scores, rejected],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run_batches, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True))
    return predict(docs, learn(docs.where(~held_out)), held_out)


SQL = None
