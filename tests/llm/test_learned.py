"""Toxicity, language identification and the language model."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from firnline.llm import kneser_ney, language_id, toxicity
from firnline.llm.columns import read_table

from .fixtures import LOWER, messy, prose

SF = "/root/testdata/sf0.1"


def test_composed_machine_equals_the_marks_one_after_another():
    machine = toxicity.grammar()
    assert machine.run("N W W I".split()) == ["N", "W", "W", "I-"]
    assert machine.run("N W W W I".split())[-1] == "I"
    assert machine.run("R W W W W W T".split())[-1] == "T'"
    assert machine.run("Y N I".split())[-1] == "I-+"
    assert machine.run("R Y N I W I".split()) == ["R", "Y", "N", "I-'+", "W", "I-'+"]


def test_negated_and_reported_insults_score_less():
    model = toxicity.Model({"idiot": 0.95}, {"morn": 0.9}, {}, 0.0)
    plain, aimed, negated, reported = map(model.score, ("an idiot here", "you idiot", "not an idiot", "they said idiot"))
    assert aimed > plain > reported > negated > 0
    assert model.score("mornings of mornix") > 0.5 and model.score("morn") == 0.0
    assert model.score("not, idiot") == plain  # a clause ends at the comma


def test_planted_insults_are_learned_and_clean_texts_left(spark):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        text = prose(i % 300, 40) + (f" vorx{chr(97 + i % 7)}{chr(97 + i % 11)} {prose(i, 3)} glumpf {prose(i + 1, 2)}" if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(toxicity.training_rows(docs), toxicity.training_rows(table))
    assert "glumpf" in model.words
    scored = toxicity.toxicity(docs, model).collect()
    assert all((r.score >= toxicity.THRESHOLD) == (r.doc_id % 9 == 0) for r in scored)
    assert toxicity.without_toxic(docs, model).count() == 800


def test_toxicity_of_messy_rows_and_empty_tables(spark):
    docs, rows = messy(spark)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    model = toxicity.learn(none, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    scored = toxicity.toxicity(docs, model).collect()
    assert len(scored) == len(rows) and all(r.score == 0.0 for r in scored)
    assert toxicity.toxicity(none, model).count() == 0


def test_held_out_insults(spark):
    scored = {r.doc_id: r for r in toxicity.run(spark, SF).where("held_out").collect()}
    labels = {r.doc_id: r.toxic for r in read_table(spark, SF, "labels").collect()}
    seen = [(scored[i].predicted, toxic) for i, toxic in labels.items() if i in scored]
    wrong = sum(p == 1 and t == 0 for p, t in seen)
    assert wrong <= 0.02 * len(seen)
    assert sum(p == t for p, t in seen) >= 0.96 * len(seen)


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in read_table(spark, SF, "documents").select("doc_id", "lang").collect()}
    found = language_id.run(spark, SF).collect()
    assert len(found) == len(truth)
    tested = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_messy_rows(spark):
    docs, rows = messy(spark)
    some = language_id.learn(spark.createDataFrame([(1, "der die das und", "de"), (2, "the of and to", "en"), (3, "x", None), (None, "y", "fr")], "doc_id bigint, text string, lang string"))
    assert {lang for lang, _ in some} == {"de", "en"}
    found = language_id.predict(docs, some, F.lit(True)).collect()
    assert len(found) == len(rows)
    assert sum(r.lang_pred == "und" for r in found) == sum(not any(map(str.isalpha, t or "")) for _, t in rows)
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert language_id.learn(none) == []
    assert {r.lang_pred for r in language_id.predict(docs, [], F.lit(True)).collect()} == {"und"}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), " end"]


def brute_model(texts):
    """Bigram model by dictionaries: probability of a word behind another, and the counts."""
    split = [tokens(t) for t in texts]
    single = Counter(w for t in split for w in t)
    pairs = Counter(p for t in split for p in zip([" start", *t[:-1]], t))
    behind, front, kinds = Counter(), Counter(w for _, w in pairs), Counter()
    for (v, _), n in pairs.items():
        behind[v] += n
        kinds[v, min(n, 3)] += 1

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        raw = [k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 0) for k in (1, 2, 3)]
        return [0.0] + [min(max(d, 0.1), k) for d, k in zip(raw, (1, 2, 3))]

    high, low = discounts(pairs.values()), discounts(front.values())
    rest = sum(low[min(c, 3)] for c in front.values()) / len(pairs) if pairs else 1.0

    def word(w):
        return (max(front[w] - low[min(front[w], 3)], 0) / len(pairs) if pairs else 0) + rest / (len(single) + 1)

    def probability(v, w):
        if not behind[v]:
            return word(w)
        n = pairs[v, w]
        return max(n - high[min(n, 3)], 0) / behind[v] + sum(high[k] * kinds[v, k] for k in (1, 2, 3)) / behind[v] * word(w)

    return probability, single


def test_language_of_each_row_equals_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    made = language_id.learn(docs.where("doc_id % 5 <> 0"))
    expected = {}
    for r in docs.collect():
        words = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        body = " ".join(words.split()).encode()
        sizes = []
        for order, (lang, content) in enumerate(made):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            small = zstandard.ZstdCompressor(level=6, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(small.compress(body[k:k + 2000])) for k in range(0, len(body), 2000)), order, lang))
        expected[r.doc_id] = min(sizes)[2] if body else "und"
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, made, F.lit(False)).collect()} == expected


def test_repeated_ids_give_one_text_each(spark):
    rows = [(1, f"wort{'a' * i} und der", "de") for i in range(200)] + [(2, "the one text", "en")]
    made = dict(language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert made == {"de": b"wort und der", "en": b"the one text"}


@pytest.mark.parametrize("size", ["messy", "documents"])
def test_language_model_equals_brute_force(spark, size):
    if size == "messy":
        docs, rows = messy(spark)
    else:
        docs = read_table(spark, "/root/testdata/sf0.001", "documents")
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    trained = [t for i, t in rows if i is not None and i % 3]
    probability, single = brute_model(trained)
    total = sum(single.values())
    found = kneser_ney.score(docs, kneser_ney.train(docs.where("doc_id % 3 != 0")), F.lit(False)).collect()
    expected = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((single[x] + 1) / (total + len(single) + 1)) for x in w)
        expected.append((i, len(w), sum(x in single for x in w), base, sum(math.log10(probability(v, x)) for v, x in zip([" start", *w[:-1]], w))))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in found), key=key)
    for g, e in zip(got, sorted(expected, key=key), strict=True):
        assert g[:3] == e[:3] and g[3:] == pytest.approx(e[3:], rel=1e-9, abs=1e-6)
    assert {r.train_tokens for r in found} == {total}


def test_language_model_sums_to_one():
    probability, single = brute_model(["a b c a b", "a c", None])
    for v in ["a", "b", " start", "never"]:
        assert sum(probability(v, w) for w in single) + probability(v, "unknown") == pytest.approx(1.0)


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    model = kneser_ney.train(none)
    assert kneser_ney.score(none, model, F.lit(True)).count() == 0
    assert [(r.n_tokens, r.n_known, r.score, r.train_tokens) for r in kneser_ney.score(some, model, F.lit(True)).orderBy("doc_id").collect()] == [(3, 0, 0.0, 0), (1, 0, 0.0, 0)]


def test_packed_counts_come_back():
    import numpy as np

    keys = np.array([0, 5, 2**40, 2**64 - 1], np.uint64)
    a, b = np.array([1, 2, 3, 2**32 - 1]), np.array([0, 0, 7, 1])
    back = kneser_ney.unpack(kneser_ney.pack(keys, a, b), 4, 2)
    assert all((x == y).all() for x, y in zip(back, (keys, a, b)))
