"""Benchmark decontamination with a broadcast set of hashed n-grams.

Windows of consecutive item words are hashed into a set that is broadcast while its
size is under a checked bound, and met by a shuffled join of hashes beyond it. Every document
window is looked up by its hash, each hit is verified on the words themselves, and the
hits of a document become word spans. The plan has DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import WORD, read_table, text_or_empty, words
from firnline.session import materialise

QUERY = "op2_decontamination"

WINDOW = 13
#: Most bytes of window words that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Words of a part of a text whose windows are opened together.
PART_WORDS = 1000
#: Beyond that, tasks that share the windows of one hash, and hits from which on a window counts as frequent.
SALTS, FREQUENT = 16, 10_000


def _hashed(words_: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words_, start + j) for j in range(n)])


def _starts(count: Column, n: int) -> Column:
    return F.when(count >= n, F.sequence(F.lit(0), count - n)).otherwise(F.array().cast("array<int>"))


def _word_hashes(column: str) -> Column:
    return F.transform(column, lambda w: F.xxhash64(w))


def _windows(n: int) -> Column:
    return F.transform(
        _starts(F.col("n_words"), n),
        lambda i: F.struct(F.lit(n).alias("n"), _hashed(F.col("h"), i, n).alias("hash"), i.alias("at")),
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: ``n, hash, gram, items`` with the ids of the items that hold each.

    An item of fewer than ``window`` words, but not none, is one window.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(text_or_empty()).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    grams = items.select(
        "item", "n",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n"))))
        .alias("gram"),
    )
    return grams.groupBy("n", "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Contamination of each row of ``docs`` (``doc_id``, ``text``).

    Returns one row for each input row: ``doc_id, n_words, spans, items``. ``spans`` are
    disjoint ``[from, to)`` ranges of word positions in order; ``items`` are the ids, as
    strings in order, of the items with a window in the text.

    NULL and empty texts have no words and no hits. Items without words have no windows; an
    item with a NULL id makes words hit but has no name to list. Rows that share an id, or
    lack one, are judged one by one. With an empty benchmark nothing is hit. Other columns
    are not read.
    """
    grams = materialise(item_windows(benchmark, window))
    lengths = [r.n for r in grams.select("n").distinct().collect()]  # window values at most
    size = grams.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * F.size("gram"))).first()[0] or 0
    keyed = grams.select("n", "gram", "items", _word_hashes("gram").alias("h"))
    keyed = keyed.withColumn("hash", _case(lengths, lambda n: _hashed(F.col("h"), F.lit(0), n))).drop("h")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(text_or_empty()).alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    keyed = keyed.withColumnRenamed("gram", "item_words")
    if lengths and size > broadcast_bytes:
        rows = materialise(rows)  # both reads must give a row the same number
        hit = _met_shuffled(rows, keyed, lengths).groupBy("row").agg(*_found())
        none = F.array().cast("array<struct<from:int,to:int>>"), F.array().cast("array<string>")
        found = rows.select("row", "doc_id", "n_words").join(hit, "row", "left").select(
            "doc_id", "n_words", F.coalesce("raw", none[0]).alias("raw"), F.coalesce("items", none[1]).alias("items")
        )
    else:
        found = _met_broadcast(rows, keyed, lengths).groupBy("row", "doc_id", "n_words").agg(*_found())
    return found.select("doc_id", "n_words", _merged(F.col("raw")).alias("spans"), "items")


def _found() -> list[Column]:
    """Spans and items of the hits of a row."""
    span = F.struct(F.col("at").alias("from"), (F.col("at") + F.col("n")).alias("to"))
    return [
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, span))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ]


def _met_broadcast(rows: DataFrame, keyed: DataFrame, lengths: list[int]) -> DataFrame:
    """Verified hits ``row, doc_id, n_words, n, at, items``; every row has one of ``n`` 0 besides."""
    # one entry that every document meets, so that documents without hits stay
    always = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("hash"), F.lit(-1).alias("at"))
    entry = keyed.sparkSession.range(1).select(
        F.lit(0).alias("n"), F.array().cast("array<string>").alias("item_words"), F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("bigint").alias("hash"),
    )
    # every window is opened with the words around it, so long texts are cut into parts that share what a window may reach over
    reach = max(lengths, default=1) - 1
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(PART_WORDS))
    parts = F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("w", s + 1, F.lit(PART_WORDS + reach)).alias("w")))
    rows = rows.select("doc_id", "row", F.col("n_words").alias("total"), F.explode(parts).alias("p")).select("doc_id", "row", "total", "p.first", "p.w")
    rows = rows.select("doc_id", "row", "total", "first", "w", _word_hashes("w").alias("h"), F.size("w").alias("n_words"))
    windows = [_windows(n) for n in lengths]
    seen = rows.select("doc_id", "row", "total", "first", "w", F.explode(F.concat(F.array(always), *windows)).alias("x"))
    seen = seen.select("doc_id", "row", "total", "first", "w", "x.n", "x.hash", "x.at")
    met = seen.join(F.broadcast(keyed.unionByName(entry)), ["n", "hash"]).where(
        (F.col("n") == 0) | (F.slice("w", F.col("at") + 1, F.greatest("n", F.lit(1))) == F.col("item_words"))
    )
    return met.select("row", "doc_id", F.col("total").alias("n_words"), "n", (F.col("first") + F.col("at")).alias("at"), "items")


def _met_shuffled(rows: DataFrame, keyed: DataFrame, lengths: list[int]) -> DataFrame:
    """Verified hits ``row, n, at, items``.

    Windows are shuffled as numbers, the windows of one hash over ``SALTS`` tasks. Only those with
    a hash of an item get their own words back, and meet the items by a join in which frequent
    windows are broadcast.
    """
    windows = rows.select("row", _word_hashes("w").alias("h"), "n_words").select("row", F.explode(F.concat(*[_windows(n) for n in lengths])).alias("x"))
    windows = windows.select("row", "x.n", "x.hash", "x.at").withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    keys = keyed.select("n", "hash").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = materialise(windows.join(keys, ["n", "hash", "salt"], "left_semi").select("row", "n", "hash", "at"))
    of_row = near.groupBy("row").agg(F.collect_list(F.struct("n", "hash", "at")).alias("near"))
    own = F.transform("near", lambda x: F.struct(x["n"].alias("n"), x["hash"].alias("hash"), x["at"].alias("at"), F.slice("w", x["at"] + 1, x["n"]).alias("own")))
    candidates = rows.select("row", "w").join(of_row, "row").select("row", F.explode(own).alias("x")).select("row", "x.*")
    frequent = materialise(near.groupBy("n", "hash").count().where(F.col("count") > FREQUENT).select("n", "hash"))
    # not more rows than hits / FREQUENT
    kinds = {k: keyed.join(F.broadcast(frequent), ["n", "hash"], k) for k in ("left_anti", "left_semi")}
    rare = candidates.join(F.broadcast(frequent), ["n", "hash"], "left_anti").join(kinds["left_anti"], ["n", "hash"])
    often = candidates.join(F.broadcast(kinds["left_semi"]), ["n", "hash"])
    return rare.unionByName(often).where(F.col("own") == F.col("item_words")).select("row", "n", "at", "items")


def _case(lengths: list[int], value) -> Column:
    out = F.lit(None).cast("bigint")
    for n in lengths:
        out = F.when(F.col("n") == n, value(n)).otherwise(out)
    return out


def _merged(spans: Column) -> Column:
    """Disjoint ranges from ranges in order of their start: each keeps what reaches beyond the ones before it."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["end"], s["from"])
        rest = F.when(s["to"] > begin, F.array(F.struct(begin.alias("from"), s["to"].alias("to"))))
        return F.struct(
            F.greatest(acc["end"], s["to"]).alias("end"),
            F.concat(acc["out"], F.coalesce(rest, F.array().cast("array<struct<from:int,to:int>>"))).alias("out"),
        )

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])


def contamination(docs: DataFrame, benchmark: DataFrame, parts: int = 20, **options) -> DataFrame:
    """``hits`` with ``n_hit`` and ``contaminated``: at least one hit word in ``parts`` words."""
    found = hits(docs, benchmark, **options).withColumn("n_hit", _n_hit())
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay. Each row is judged by its text, whatever its id."""
    bad = contamination(_by_text(docs), benchmark, **options).where("contaminated").select(F.col("doc_id").alias("_bad"))
    bad = materialise(bad.distinct())
    return docs.join(bad, _text_key() == bad["_bad"], "left_anti")


def _text_key() -> Column:
    return F.md5(text_or_empty().cast("binary"))


def _by_text(docs: DataFrame) -> DataFrame:
    """The texts of ``docs``, named by themselves."""
    return docs.select(_text_key().alias("doc_id"), "text")


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with hit words, each with what separates it from the next word, cut out of ``text``, whatever the id."""
    found = hits(_by_text(docs), benchmark, **options).where(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias("_id")).agg(F.any_value("spans").alias("_spans"))
    word = WORD[:2] + WORD[2:].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # both cases
    rest = word[0] + word[2:-1]
    pieces = F.regexp_extract_all("text", F.lit(f"{word}{rest}*"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (i >= s["from"]) & (i < s["to"])))
    cut = F.concat(F.regexp_extract("text", f"^{rest}*", 0), F.array_join(kept, ""))
    joined = docs.join(found, _text_key() == found["_id"], "left")
    return joined.select(
        *[F.when(F.col("_spans").isNotNull(), cut).otherwise(docs["text"]).alias(c) if c == "text" else docs[c] for c in docs.columns]
    )


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi
), ln AS (
  SELECT DISTINCT n FROM g
), di AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln WHERE len(w) >= n
), x AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di
), h AS (
  SELECT x.doc_id, x.n, x.i, g.item_id FROM x JOIN g ON x.n = g.n AND x.g = g.g
), p AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h
), c AS (
  SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
