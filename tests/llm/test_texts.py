"""Pages, token files, SentencePiece, the similarity join and the pipeline."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece as library
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from firnline.llm import decontamination, html_extraction, ngram_join, sentencepiece, shingles, token_files, toxicity
from firnline.llm.columns import read_table
from firnline.llm.shared_files import new_folder
from firnline.llm.token_counts import vocabulary_path

from .fixtures import ids_key, messy, prose, with_clashes, words

SF = "/root/testdata/sf0.001"


def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<header><h1>Site</h1></header><nav><ul><li>Home<li>About {i}</ul></nav><div class='ad'>Buy {i}</div>{body}"
        f"<aside>Side {i}</aside><div class=\"cookie-notice\">Cookies</div><form>Name <input></form>{extra}<footer>&copy; {i}</footer></body></html>"
    )


def test_pages_of_a_host_lose_their_template(spark):
    rows = []
    for i in range(12):
        body = (
            f"<article><h2>Title &amp; {i}</h2><p>Read more news here.</p><p><b>First {prose(i, 5)}<br><p>Second &lt;{i}&gt;\n  line</p>"
            f"<div class='comments'><p>Nice {i}</p></div></article>"
        )
        rows.append((i, f"https://a.example/{i}", page(i, body)))
    found = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {i: f"Title & {i} First {prose(i, 5)} Second <{i}> line" for i in range(12)}


def test_every_layout_of_a_host_has_its_template(spark):
    rows = [(0, "https://h.example/error", "<body><h1>Not found")]
    for i in range(1, 81):
        kind = ("news", "shop", "forum", "wiki")[i % 4]
        rows.append((i, f"https://h.example/{i}", f"<body class='{kind}'><div class='{kind}-top'><p>About {kind}</div><div class='{kind}-text'><p>{prose(i, 5)}</div></body>"))
    found = {r.page_id: r.text for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {0: "Not found"} | {i: prose(i, 5) for i in range(1, 81)}


def test_single_and_messy_pages(spark):
    rows = [
        (1, "https://solo.example/", page(1, "<main><p>Only&nbsp;page</p></main>")), (2, None, "<p>no address</p>"), (3, "x", None), (4, "", ""),
        (None, "https://b.example", "lone < text <b>bold"), (5, "https://b.example", "<article><p>a</div></p>b</article"), (5, "https://b.example", "<!-- open <p>x"),
        (6, "https://b.example", "<div>" * 3000 + "deep"), (7, "https://c.example", "<article>" + "<p>word " * 3000 + "</article>"),
    ]
    found = html_extraction.main_text(with_clashes(spark, rows, "page_id bigint, url string, html string")).collect()
    assert Counter((r.page_id, r.text) for r in found) == Counter([
        (1, "Only page"), (2, "no address"), (3, ""), (4, ""), (None, "lone < text bold"), (5, "a b</article"), (5, ""), (6, "deep"), (7, " ".join(["word"] * 3000)),
    ])
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_extraction.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("body, text", [
    ("<body class='no-sidebar'><p>Kept", "Kept"), ("<body class='has-header'><div>Kept", "Kept"), ("<body class='sidebar'><div>Kept", "Kept"),
    ("<html class='cookie-notice'><body><p>Kept", "Kept"), ("<body><div class='content with-sidebar'><p>Kept</div>", "Kept"),
    ("<body><article class='post comments-open'><p>Kept</article>", "Kept"), ("<body><article class='related'><p>Kept</article>", "Kept"),
    ("<body><main class='widget'><p>Kept</main><p>rest", "Kept"), ("<body><div class='overlay'><nav>N</nav><main><p>Kept</main></div>", "Kept"),
    ("<body><div id='modal'><article><p>Kept and kept</article></div><p>rest", "Kept and kept"),
    ("<body><form><nav>N</nav><div><p>Kept <input></div></form>", "Kept"), ("<body><form><div>Kept whole text</div></form><div>address</div>", "Kept whole text address"),
    ("<body><main><p>One</main><div>between</div><main><p>Two</main>", "One Two"), ("<body><main><h1>Title</h1><article>A</article><p>After</main>", "Title A After"),
    ("<body><main><form>Search</form><p>Kept text</main>", "Kept text"), ("<body><div class='popup'><p>Most of it</div><div class='ad'>Buy</div>", "Most of it"),
    ("<body><div class='site-footer'>F</div><ul class='comment-list'><li>C</ul><div id='cookie-notice'>C</div><p>Kept", "Kept"),
    ("<body><article><p>Kept text<article class='comment'>C</article></article>", "Kept text"), ("<body><nav>N</nav><footer>F</footer>", ""),
])
def test_names_of_layouts_do_not_drop_content(body, text):
    assert " ".join(t for _, t in html_extraction.slots(html_extraction.parse(f"<!DOCTYPE html>{body}"))) == text


def test_every_page_keeps_its_whole_article(spark):
    import html
    import re

    pages = read_table(spark, SF, "pages")
    found = {r.page_id: r.text for r in html_extraction.main_text(pages).collect()}
    for p in pages.collect():
        blocks = re.split(r"</?(?:p|h1|br|b)>", re.search(r"<article>(.*)</article>", p.html, re.S)[1])
        assert found[p.page_id] == " ".join(html.unescape(" ".join(blocks)).split())


def test_tree_matching_is_the_largest():
    def tree(n):
        return html_extraction.parse(n)

    a, b = "<div><p>1</p><ul><li>x</li></ul><p>2</p></div>", "<div><p>1</p><p>2</p></div>"
    reference = html_extraction.numbered(html_extraction.json.loads(html_extraction.skeleton(tree(b))))[0]
    found = html_extraction.align(tree(a), reference)
    assert sorted(found.values()) == [(0, True), (1, True), (2, True), (3, True)]


def test_token_files_hold_all_documents_in_order(spark):
    path, (docs, rows) = vocabulary_path("byte_bpe_50k.json"), messy(spark)
    folder, known = new_folder(spark), Tokenizer.from_file(path)
    manifest = token_files.write_token_files(docs, folder, path, length=8).orderBy("shard").collect()
    at, expected = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.read_documents(spark, folder).orderBy("start").collect()]
    assert got == expected
    for m in manifest:
        shard = token_files.Shard(f"{folder}/{m.file}.arrow")
        masks = [shard[i][1].to_pylist() for i in range(len(shard))]
        assert len(shard) == m.n_sequences and sum(map(sum, masks)) == m.n_tokens and all(len(x) == 8 for x in masks)
        with pytest.raises(IndexError):
            shard[len(shard)]


def test_token_files_of_an_empty_table(spark):
    folder = new_folder(spark)
    token_files.write_token_files(spark.createDataFrame([], "doc_id bigint, text string"), folder, vocabulary_path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, folder).count() == 0


@pytest.mark.parametrize("more", [[], [" ", "  ", "a ", "x" * 200, " " * 130 + "end", "▁a▁▁b", "<s></s><unk><0x0A>", "In In!!! $$$", "é" * 61, "aaaa bbbbbbb", ".\n.\t1\n", "\n", "a.\n\n(b)日!语"]])
def test_encoding_equals_the_library(spark, more):
    docs, rows = messy(spark)
    if more:
        rows = list(enumerate(more))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pieces = sentencepiece.read_model(vocabulary_path("piece_bpe_32k.model"))
    model = library.SentencePieceProcessor(model_file=pieces.path)
    encoded = sentencepiece.encode(docs, pieces)
    got = sorted(((r.doc_id, r.ids, r.round_trip) for r in encoded.collect()), key=lambda x: (ids_key(x[0]), x[1]))
    assert got == sorted(((i, model.encode(t or ""), True) for i, t in rows), key=lambda x: (ids_key(x[0]), x[1]))
    texts = Counter(r.text for r in sentencepiece.decode(encoded, pieces).collect())
    assert texts == Counter((t or "").replace("▁", " ") for _, t in rows)


def test_long_words_that_start_without_a_space_equal_the_library(spark):
    texts = [
        "title\n" + "=" * 70, "x" + "-" * 80, "2024" + "a" * 70, "2024" + "年の日本語" * 15, "no." + "7" * 61, "(" + "ไทย" * 40 + ")", "\"" + "Word" * 30,
        "a\n" + "* " * 40 + "_" * 100 + "\nb", "_" * 200 + "é" * 90, "1" + "😀" * 61, "end" + " " * 70 + "=" * 70, "=" * 61, "x" * 61 + "=" * 61 + "x" * 60 + "=" * 60,
    ]
    pieces = sentencepiece.read_model(vocabulary_path("piece_bpe_32k.model"))
    model = library.SentencePieceProcessor(model_file=pieces.path)
    encoded = sentencepiece.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), pieces)
    assert {r.doc_id: (r.ids, r.round_trip) for r in encoded.collect()} == {i: (model.encode(t), True) for i, t in enumerate(texts)}


def test_encoding_an_empty_table(spark):
    pieces = sentencepiece.read_model(vocabulary_path("piece_bpe_32k.model"))
    assert sentencepiece.encode(spark.createDataFrame([], "doc_id bigint, text string"), pieces).count() == 0


def best_merges(word, scores):
    """Symbols after joining the best-scored, then leftmost neighbours until none are a piece."""
    symbols = list(word)
    while True:
        joins = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not joins:
            return symbols
        i = min(joins)[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("kept, limit", [(0.03, 50), (0.3, 10_000), (0.3, 0)])
def test_merges_visited_once_equal_the_best_merge_each_time(spark, monkeypatch, kept, limit):
    monkeypatch.setattr(sentencepiece, "LATE", limit)
    rng = random.Random(6)
    names = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("abcd", repeat=n)]
    names = [p for p in names if len(p) == 1 or rng.random() < kept * (5 - len(p))] + ["▁"]
    scores = {p: float(-rng.randint(0, 60)) for p in names}
    pieces = sentencepiece.Pieces("", "bpe", [(p, i, s) for i, (p, s) in enumerate(scores.items())], list(range(1000, 1256)), 4)
    words = sorted({"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(400)})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    bounds = sentencepiece.merged_in_any_order(F.col("edges"), F.char_length("word"), sentencepiece.late_pieces(pieces))
    got = {r.word: [names[i] for i in r.ids] for r in sentencepiece.path_ids(sentencepiece.lattice(table, pieces), bounds, pieces.bytes_).collect()}
    assert got == {w: best_merges(w, scores) for w in words}


def test_late_pieces_open_after_a_worse_merge():
    rows = [(p, i, s) for i, (p, s) in enumerate({"▁": -9.0, "a": -9.0, "b": -9.0, "c": -9.0, "ab": -3.0, "abc": -1.0, "bc": -2.0, "bca": -4.0}.items())]
    assert sentencepiece.late_pieces(sentencepiece.Pieces("", "bpe", rows, [], 3)) == ["abc"]
    late = sentencepiece.late_pieces(sentencepiece.read_model(vocabulary_path("piece_bpe_32k.model")))
    assert late == ["▁" * 16]


def test_characters_that_no_piece_joins_are_words():
    split = sentencepiece.splitter(sentencepiece.read_model(vocabulary_path("piece_bpe_32k.model")))
    assert split("a\nb  \n😀c, 1 ") == ["▁a", "\n", "b", "▁▁", "\n", "😀", "c", ",", "▁1", "▁"]
    assert split("") == []


def test_viterbi_finds_the_best_path(spark):
    rng = random.Random(5)
    letters = "▁abc"
    table = {"".join(p): -rng.random() * 5 - 1 for n in (1, 2, 3) for p in itertools.product(letters, repeat=n) if rng.random() < 0.5 or n == 1}
    rows = [(p, i, s) for i, (p, s) in enumerate(table.items()) if p != "c"]
    pieces = sentencepiece.Pieces("", "unigram", rows, list(range(1000, 1256)), 3)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    unknown = min(s for _, _, s in rows) - 10.0
    scores = {p: s for p, _, s in rows}

    def best(word):
        found = [(0.0, ())] + [None] * len(word)
        for e in range(1, len(word) + 1):
            found[e] = max(
                (found[s][0] + scores.get(word[s:e], unknown if e - s == 1 else -1e9), (*found[s][1], word[s:e]))
                for s in range(max(0, e - 3), e)
            )
        return found[-1][0]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoded = {r.word: r.ids for r in sentencepiece.encoded_words(docs, pieces).collect()}
    names = {i: p for p, i, _ in rows}
    for t in texts:
        ids = encoded["▁" + t]
        surface = [names.get(i, chr(i - 1000) if i >= 1000 else "?") for i in ids]
        assert "".join(surface) == "▁" + t
        assert sum(scores.get(p, unknown) for p in surface) == pytest.approx(best("▁" + t))


def brute_classes(rows, threshold=0.8):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    of = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        of[s].append(i)
    distinct = [s for s in of if s]
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = Counter()
    for a, b in itertools.combinations(distinct, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-12:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    members = defaultdict(list)
    for s in distinct:
        members[find(s)] += [i for i in of[s] if i is not None]
    for (i, _), s in zip(rows, sets):
        known = [x for x in of[s] if x is not None]
        yield (i, min(members[find(s)], default=None), links[s], min(known, default=None), len(of[s])) if s else (i, i, 0, i, 1)


def near_rows():
    """Copies, near copies of all grades, chains of near copies and unrelated texts."""
    rng, rows = random.Random(3), []
    for family in range(12):
        base = prose(family + 20, 150).split()
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    chain = prose(77, 200).split()
    for k in range(8):
        rows.append((len(rows), " ".join(chain[k * 12:k * 12 + 100])))
    return rows


@pytest.mark.parametrize("blocks", [(1000, 1 << 20), (3, 1 << 20)])
def test_similar_documents_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks[0])
    docs, rows = messy(spark)
    rows = [*((None if i is None else i + 1000, t) for i, t in rows), *near_rows()]
    docs = with_clashes(spark, rows, "doc_id bigint, text string").repartition(4)
    assert Counter(tuple(r) for r in ngram_join.similar_documents(docs).collect()) == Counter(brute_classes(rows))


def test_prefixes_are_shortened_until_the_recall_is_expected():
    assert ngram_join.expected_recall({}, 8) == 1.0
    long, short = (ngram_join.expected_recall({80: 10}, k) for k in (8, 3))
    assert long < short <= 1.0 and long > 0.9999
    assert ngram_join.expected_recall({99: 10}, 8) > long


def test_next_prefix_is_the_longest_that_finds_the_least_similar_links():
    assert ngram_join.next_prefix({}, ngram_join.DEPTH, ngram_join.RECALL) is None
    assert ngram_join.next_prefix({95: 3}, ngram_join.DEPTH, ngram_join.RECALL) is None
    assert ngram_join.next_prefix({80: 1, 99: 10**9}, ngram_join.DEPTH, ngram_join.RECALL) == 8
    assert ngram_join.next_prefix({80: 1}, 8, ngram_join.RECALL) is None
    assert ngram_join.next_prefix({20: 1}, ngram_join.DEPTH, ngram_join.RECALL) == ngram_join.LEAST_PREFIX
    assert ngram_join.next_prefix({20: 1}, ngram_join.LEAST_PREFIX, ngram_join.RECALL) is None


@pytest.mark.parametrize("steps", [1, 2, 3, 7])
def test_every_step_of_the_shortening_finds_links_of_brute_force(spark, monkeypatch, steps):
    rows, took = near_rows(), []

    def stepwise(similarities, prefix, recall):
        took.append(prefix)
        return prefix - 1 if len(took) < steps else None

    monkeypatch.setattr(ngram_join, "next_prefix", stepwise)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r.n_links for r in ngram_join.similar_documents(docs).collect()}
    exact = {i: n for i, _, n, _, _ in brute_classes(rows)}
    assert took == list(range(ngram_join.DEPTH, ngram_join.DEPTH - steps, -1))
    assert all(found[i] <= n for i, n in exact.items())
    assert sum(found.values()) >= 0.9 * sum(exact.values())
    if ngram_join.DEPTH - steps < 8:
        assert found == exact


def test_production_settings_shorten_where_links_are_near_the_threshold(spark, monkeypatch):
    took, plain = [], ngram_join.next_prefix
    monkeypatch.setattr(ngram_join, "next_prefix", lambda *a: (took.append(a[1]), plain(*a))[1])
    rows = near_rows()
    found = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_classes(rows))
    assert took[0] == ngram_join.DEPTH and len(took) > 1


def test_shared_prefixes_of_trie_rows_are_counted():
    import pyarrow as pa

    rng = random.Random(6)
    first = [rng.randrange(1 << ngram_join.BITS) for _ in range(ngram_join.TREES * ngram_join.DEPTH)]
    depths = [t % (ngram_join.DEPTH + 1) for t in range(ngram_join.TREES)]
    second = [x if i % ngram_join.DEPTH < depths[i // ngram_join.DEPTH] else x ^ 1 for i, x in enumerate(first)]
    one, two = (ngram_join.trie_rows(np.array(x, np.uint8)) for x in (first, second))
    for tree, depth in enumerate(depths):
        (low, a), (high, b) = sorted([(int(one[tree]), 1), (int(two[tree]), 2)])
        batch = pa.RecordBatch.from_pydict({"part": [0, 0], "tree": [tree, tree], "row": [low, high], "k1": [a, b]})
        links = [r for x in ngram_join._neighbours([batch]) for r in x.to_pylist() if r["shared"] is not None]
        assert [r["shared"] for r in links] == ([depth] if depth >= ngram_join.LEAST_PREFIX else [])


def test_signatures_estimate_similarity():
    common, a, b = (shingles.mix(np.arange(x, y, dtype=np.uint64)) for x, y in ((0, 800), (1000, 1100), (2000, 2100)))
    one, two = (ngram_join.signature(np.sort(np.concatenate([common, x]))).view(np.uint8) for x in (a, b))
    assert abs((one == two).mean() - 0.8) < 0.08


def test_word_hashes_split_like_the_pattern():
    import pyarrow as pa

    texts = ["Ab c1 é!", None, "", "x" * 100 + " y", "UPPER upper", "\x00a\x7fb"]
    hashes, bounds = shingles.word_hashes(pa.array(texts))
    of, seen = [hashes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], {}
    for t, h in zip(texts, of):
        assert len(h) == len(words(t))
        assert all(seen.setdefault(w, x) == x for w, x in zip(words(t), h))
    assert len(set(seen.values())) == len(seen)


def test_no_near_copies_in_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.similar_documents(none).count() == 0
    assert ngram_join.without_near_duplicates(none).columns == ["doc_id", "text"]


def test_pipeline_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        path = new_folder(spark)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.learn(toxicity.training_rows(read_table(spark, SF, "documents")), toxicity.training_rows(read_table(spark, SF, "labels")))
            assert kept[name] == {i for i, t in before if model.score(t) < toxicity.THRESHOLD}
        if name == "exact_dedup":
            groups = defaultdict(list)
            for i, t in before:
                groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i))
            assert kept[name] == {min(g)[1] for g in groups.values()}
        if name == "ngram_join":
            assert kept[name] == {i for i, c, *_ in brute_classes(before) if i == c}
        if name == "decontamination":
            bad = decontamination.contamination(spark.createDataFrame(before, "doc_id bigint, text string"), read_table(spark, SF, "benchmark")).where("contaminated")
            assert kept[name] == {i for i, _ in before} - {r.doc_id for r in bad.collect()}
        if name == "sentencepiece":
            model = library.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
            assert {r.doc_id: r.ids for r in docs.collect()} == {i: model.encode(t) for i, t in before}
    assert docs.where(~F.col("round_trip")).isEmpty()


def test_queries_carry_every_document(spark):
    from firnline import llm

    assert len(llm.queries()) == 13 and all(n.startswith("op") for n in llm.queries())
