"""Exact deduplication, decontamination and token counts against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firnline.llm import decontamination, exact_dedup, token_counts
from firnline.llm.columns import read_table

from .fixtures import ids_key, messy, prose, words

SF = "/root/testdata/sf0.001"


def test_exact_groups_of_messy_rows(spark):
    docs, rows = messy(spark)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    expected = Counter()
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")]
        keep = min(g)[3]
        expected[i, keep, len(g), i == keep] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == expected


@pytest.mark.parametrize("files_per_batch", [1, 10_000])
def test_colliding_digests_are_told_apart_by_full_bytes(spark, files_per_batch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "ab", "ba", "c", "ab ", "ba"])], "doc_id bigint, text string")
    same_length = lambda body: F.unhex(F.hex(F.char_length(body)))
    found = exact_dedup.exact_duplicates(docs.repartition(3), digest=same_length, files_per_batch=files_per_batch).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == [(0, 0, 3), (1, 0, 3), (2, 2, 2), (3, 3, 1), (4, 0, 3), (5, 2, 2)]


def test_state_reaches_across_batches(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(20)], "doc_id bigint, text string")
    found = exact_dedup.exact_duplicates(docs.repartition(5), files_per_batch=1).where("group_size > 1").collect()
    assert {(r.keep_id, r.group_size) for r in found} == {(1, 10)} and len(found) == 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.without_duplicates(none).columns == ["doc_id", "text"]
    assert decontamination.contamination(none, items).count() == 0
    assert token_counts.token_counts(none, token_counts.vocabulary_path("byte_bpe_50k.json")).count() == 0


def test_without_duplicates_keeps_all_columns(spark):
    docs = read_table(spark, SF, "documents")
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.select(exact_dedup.normalised(F.col("text"))).distinct().count()


def brute_contamination(rows, items, window=13):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            grams[tuple(w[i:i + n])].add(item)
    lengths = {len(g) for g in grams}
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        yield doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)


ITEMS = [(1, prose(9, 30)), (2, "short one"), (3, None), (4, "..."), (10, prose(9, 30)), (None, prose(8, 14)), (5, "a a a a a a a a a a a a a a")]


@pytest.mark.parametrize("broadcast_bytes", [0, decontamination.BROADCAST_BYTES])
def test_contamination_of_messy_rows(spark, broadcast_bytes):
    rows = messy(spark)[1] + [
        (100, prose(4, 50) + " " + prose(9, 30).upper() + " end"), (101, prose(9, 12)), (102, prose(8, 14)), (103, "a " * 40),
        (104, prose(5, 400) + " " + " ".join(prose(9, 30).split()[3:16])),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.contamination(docs, items, broadcast_bytes=broadcast_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in found), key=lambda x: (ids_key(x[0]), x[1]))
    expected = [(d, n, h, i, h > 0 and 20 * h >= n) for d, n, h, i in brute_contamination(rows, ITEMS)]
    assert got == sorted(expected, key=lambda x: (ids_key(x[0]), x[1]))


@pytest.mark.parametrize("frequent", [2, 10_000])
def test_shuffled_windows_are_small_and_frequent_passages_spread(spark, monkeypatch, frequent):
    monkeypatch.setattr(decontamination, "FREQUENT", frequent, raising=False)
    passage = prose(9, 30)
    rows = [(0, prose(6, 3000)), (1, prose(7, 3000) + " " + passage), (None, ""), *((i, f"{passage} {prose(i, 5)}") for i in range(2, 12))]
    docs, items = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, broadcast = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontamination.contamination(docs, items, broadcast_bytes=0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in found), key=lambda x: ids_key(x[0]))
    assert got == sorted(brute_contamination(rows, ITEMS), key=lambda x: ids_key(x[0]))
    # two texts of 3,000 words, whose windows would be 100 MB and more with the whole text in each
    assert written() - before < 10 << 20


def test_spans_are_cut_out_and_documents_dropped(spark):
    rows = [(1, "Keep this, " + prose(9, 30) + "; and that."), (2, "clean text"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    cut = {r.doc_id: r.text for r in decontamination.without_spans(docs, items).collect()}
    assert cut == {1: "Keep this, and that.", 2: "clean text", 3: None}
    assert sorted(r.doc_id for r in decontamination.without_contaminated(docs, items).collect()) == [2, 3]


def test_contamination_without_items(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r.items) for r in decontamination.contamination(docs, items).collect()] == [(2, 0, [])]


@pytest.mark.parametrize("frequent,size", [(0, 1 << 24), (3, 1 << 24), (400_000, 1 << 24), (400_000, 8)])
def test_token_counts_equal_the_tokenizer(spark, frequent, size):
    path = token_counts.vocabulary_path("byte_bpe_50k.json")
    docs, rows = messy(spark)
    more = ["x<|endoftext|> y  <|endoftext|>  ", "don't 's  \n\n\n z q\x1c\x1d a\x85", "à ١٢ ½ 😀😀 　　a", "a\x00b\x00 ", "''ll 'LL"]
    rows = rows + list(enumerate(more, 200))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-len(more):], "doc_id bigint, text string"))
    known = Tokenizer.from_file(path)
    expected = Counter((i, len((t or "").encode()), len(known.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, path, frequent, size).collect()) == expected


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.added_tokens(token_counts.vocabulary_path("word_bpe_49k.json"))


def test_query_plans_have_no_python(spark):
    for module in (exact_dedup, decontamination):
        plan = module.run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_digest_is_that_of_the_normalised_text(spark):
    docs = spark.createDataFrame([(1, " a\tB ")], "doc_id bigint, text string")
    row = exact_dedup.exact_duplicates(docs).first()
    assert bytes(row.digest) == hashlib.sha256(b"aB").digest()
