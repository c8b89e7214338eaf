"""Removal of rows where ids repeat or are missing: decisions go by row, not by id."""

from collections import Counter

from firnline.llm import decontamination, exact_dedup, ngram_join, token_files
from firnline.llm.token_counts import vocabulary_path

from .fixtures import prose, with_clashes

SCHEMA = "doc_id bigint, text string"


def kept(found):
    return Counter((r.doc_id, r.text) for r in found.select("doc_id", "text").collect())


def test_exact_copies_go_by_row(spark):
    rows = [(0, "alpha beta"), (1, "alpha beta"), (1, "unique other text"), (2, "x y"), (2, "xy"), (2, "xy"), (3, "xy"), (None, "xy"), (None, "alone"), (None, "z"), (None, "z"), (5, None), (5, "")]
    found = exact_dedup.without_duplicates(with_clashes(spark, rows, SCHEMA))
    # rows whose text is NULL count as empty
    assert Counter((i, t or "") for i, t in kept(found).elements()) == Counter(
        [(0, "alpha beta"), (1, "unique other text"), (2, "x y"), (None, "alone"), (None, "z"), (5, "")]
    )


def test_near_copies_go_by_row(spark):
    base, other = prose(1, 60), prose(2, 60)
    rows = [(4, base), (4, base + " tail"), (4, other), (5, other), (5, "short"), (5, None), (6, base), (None, base), (None, prose(3, 40)), (None, prose(3, 40)), (7, ""), (7, "")]
    found = kept(ngram_join.without_near_duplicates(with_clashes(spark, rows, SCHEMA)))
    of_base = [k for k in found if k in {(4, base), (4, base + " tail")}]
    assert len(of_base) == 1 and found[of_base[0]] == 1
    del found[of_base[0]]
    assert found == Counter([(4, other), (5, "short"), (5, None), (None, prose(3, 40)), (7, ""), (7, "")])


def test_contamination_goes_by_row(spark):
    passage = prose(1, 20)
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    rows = [(1, passage), (1, prose(2, 30)), (2, "before " + passage + " behind " + prose(3, 5)), (2, "here " + prose(4, 12) + " " + passage), (None, passage), (None, prose(5, 9)), (3, None)]
    docs = with_clashes(spark, rows, SCHEMA)
    assert kept(decontamination.without_contaminated(docs, items)) == Counter([(1, prose(2, 30)), (None, prose(5, 9)), (3, None)])
    cut = kept(decontamination.without_spans(docs, items))
    assert cut == Counter([
        (1, ""), (1, prose(2, 30)), (2, "before behind " + prose(3, 5)), (2, "here " + prose(4, 12) + " "), (None, ""), (None, prose(5, 9)), (3, None),
    ])


def test_tokens_encoded_together_have_the_ids_of_each():
    enc = token_files.Encoder(vocabulary_path("byte_bpe_50k.json"))
    texts = [" a bb  Ccc 12 's é日 ß x" + prose(4, 700) + " ﬁ ªº Ǆ ʰʱ", "", " ", "lead  two\n three", " 日本 語 " * 4]
    expected = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(x).cast(enc.dtype.char)) for x in enc.encode(texts)] == expected


def test_hits_across_parts_of_long_texts(spark, monkeypatch):
    """Passages at, before and behind the ends of parts, and items shorter than a window."""
    from .test_native import brute_contamination

    monkeypatch.setattr(decontamination, "PART_WORDS", 50)
    passage, short = prose(1, 20), prose(6, 3)
    rows = []
    for at in [*range(25, 56), 99, 100, 101, 130]:
        w = prose(2, 150).split()
        rows.append((at, " ".join([*w[:at], passage, *w[at:at + 40], short, *w[at + 40:]])))
    rows += [(500, short), (501, None), (502, passage)]
    items = [(1, passage), (2, short), (3, passage + " more")]
    found = decontamination.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()) == sorted(brute_contamination(rows, items))
