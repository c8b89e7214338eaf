"""Token alignment, spelling variants and sketched near duplicates against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as library
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firnline.llm import sketch_dedup, spelling_variants, token_alignment
from firnline.llm.columns import read_table
from firnline.llm.token_counts import vocabulary_path

from .fixtures import LOWER, messy, messy_texts, prose, with_clashes

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


# ---- token alignment


class Whole:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = library.SentencePieceProcessor(model_file=PATH_B)
        alphabet = token_alignment.byte_alphabet()
        self.names = {i: bytes(alphabet[c] for c in n) for n, i in self.a.get_vocab().items() if all(c in alphabet for c in n)}

    def piece(self, i):
        name = self.b.id_to_piece(i)
        if re.fullmatch("<0x[0-9A-F]{2}>", name):
            return bytes([int(name[3:5], 16)])
        return name.replace("▁", " ").encode()

    def groups(self, text):
        """``(ids of A, ids of B)`` for each group, cut where the sets of ends meet; None without tokens."""
        if not text:
            return None
        raw = (" " + text).encode()
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [self.names[i] for i in ids_a], [self.piece(i) for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            i2, j2 = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            out.append((ids_a[i:i2], ids_b[j:j2]))
            i, j = i2, j2
        return out


def brute_alignment(rows):
    whole = Whole()
    found = [(i, whole.groups(t)) for i, t in rows]
    seen = Counter(p for _, g in found for p in {(a, b) for x, y in g or [] for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in seen.items():
        most[a] = max(most[a], n)
    for i, g in found:
        g = g or []
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        yield (
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(seen[p] == most[p[0]] for p in links),
            sum(seen[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        )


def assert_alignment(docs, rows):
    found = token_alignment.token_alignment(docs, PATH_A, PATH_B)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect())
    assert got == Counter(brute_alignment(rows))


STRANGE = [
    "▁ mark", "a▁b", "a  b   c", " lead", "  two", "trail ", "trail  ", "\n", "\n\n", "x\n", "x\n\n", "a\nb", "a\n\nb", "a \n b", "a\n \nb", "a \n\n  b\n c",
    "tab\tx", "tab\t\t x", "nb sp  em", "a\x1cb \x1f c", "! \x1c!", "it's we'll 'tis", "x " * 300, "日本語 テキスト。中文字", "😀😀 👩‍👩‍👧 é é", "\x00 nul \x00",
    "2024-10-11 3.14159", "foo_bar::baz(qux)", "　wide　", "\r\nline\r\n", "a" * 3000, "0" * 500, "﻿bom", "ﬁne ﬀ", "ไทยไทย", "<|endoftext|>", "<s> </s> <unk> <0x41>",
    "ENDS\n ", "a\n\tb", "x \n", " \n", " ", "   ", "\n x", " sep ", "\x85nel",
]


def test_groups_of_strange_texts_are_those_of_whole_texts(spark):
    rows = list(enumerate([*STRANGE, *messy_texts()]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert_alignment(docs, rows)


def test_alignment_of_messy_rows(spark):
    docs, rows = messy(spark)
    assert_alignment(docs, rows)


def test_alignment_of_all_documents(spark):
    docs = read_table(spark, SF, "documents")
    assert_alignment(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_random_mixes_align_as_whole_texts():
    random.seed(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "'s", "ß", "日", "12", ".", "!?", " ", "\x1d", "😀", "word", "éa"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 25))) for _ in range(1500)]
    found, whole = token_alignment.Aligner(PATH_A, PATH_B, limit=200), Whole()
    for start in range(0, len(texts), 100):
        part = texts[start:start + 100]
        counts, groups, *_ = found.align(part)
        for t, n, g in zip(part, counts.tolist(), groups):
            expected = whole.groups(t) or []
            assert g == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in expected), repr(t)
            assert n[2] == len(expected)


def test_cuts_are_all_common_ends():
    random.seed(3)
    for _ in range(500):
        n = random.randint(1, 60)
        a, b = (sorted({*random.sample(range(1, n + 1), random.randint(0, n)), n}) for _ in "ab")
        both = sorted(set(a) & set(b))
        assert token_alignment.shared_cuts(a, b) == [(a.index(x) + 1, b.index(x) + 1) for x in both]
    assert token_alignment.shared_cuts([], []) == []
    long = list(range(2, 200_001, 2))
    assert token_alignment.shared_cuts(long, [*range(1, 200_000, 2), 200_000]) == [(100_000, 100_001)]


def test_alignment_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    found = token_alignment.token_alignment(none, PATH_A, PATH_B, with_groups=False)
    assert found.count() == 0 and found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


# ---- spelling variants


def brute_words(rows, one_in=31):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    words = sorted(counts)
    by_hole = defaultdict(set)
    for w in words:
        by_hole[w].add(w)
        for i in range(len(w)):
            by_hole[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in by_hole.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None


def as_rows(found):
    return sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_all_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    counts = brute_words([(r.doc_id, r.text) for r in docs.collect()])
    assert as_rows(spelling_variants.variants_of_documents(docs)) == sorted(brute_variants(counts))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_variants_of_crowded_words(spark, levels):
    """Words over few letters have very many neighbours, edits at either end and in runs, and long chains of forms."""
    random.seed(levels)
    counts = {}
    for _ in range(900):
        w = "".join(random.choices("abé", k=random.randint(7, 11)))
        counts[w] = random.choice([2, 3, 20, 25, 250, 2600, 30_000])
    chain = "zzzzzzzzzzzzzzz"
    counts |= {chain[:7 + i]: 2 * 10**i for i in range(9)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = as_rows(spelling_variants.spelling_variants(words, levels=levels))
    assert found == sorted(brute_variants(counts))
    assert {r[2] for r in found if r[0].startswith("zzzz")} == {chain}


def test_variants_of_messy_rows(spark):
    texts = [None, "", "Straßen straßen STRASSEN straßem", "aaaaaaaa aaaaaaa aaaaaaaaa " * 30, "no", "Überall überall Überalll " * 12, "×÷×÷×÷×÷ " * 3, "longer " * 11 + "Longerr Longerr", "x" * 4000 + " " + "x" * 4000 + " " + "x" * 3999 + " " + "x" * 3999]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (None, None)]
    docs = with_clashes(spark, rows, "doc_id bigint, text string")
    assert as_rows(spelling_variants.variants_of_documents(docs)) == sorted(brute_variants(brute_words(rows)))
    assert as_rows(spelling_variants.variants_of_documents(docs.limit(0))) == []


# ---- sketched near duplicates


def brute_sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def brute_components(rows, num=85):
    sets, n = brute_sets(rows), len(rows)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(rows[i][0])
    for i in range(n):
        ids = [x for x in least[find(i)] if x is not None]
        component = min(ids) if ids else None
        yield rows[i][0], len(sets[i]), component, rows[i][0] == component


def assert_components(docs, rows):
    found = Counter(tuple(r) for r in sketch_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert found == Counter(brute_components(rows))


def test_components_of_all_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    assert_components(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_messy_rows(spark):
    docs, rows = messy(spark)
    assert_components(docs, rows)
    assert sketch_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_chains_and_near_misses(spark, monkeypatch):
    """Chains of edits reach further than any pair; many pairs lie just under the threshold. Groups are cut into small parts."""
    monkeypatch.setattr(sketch_dedup, "HELD_SETS", 4)
    monkeypatch.setattr(sketch_dedup, "STREAMED_SETS", 7)
    random.seed(7)
    rows = []
    for c in range(12):
        w = prose(c, 150).split()
        for _ in range(random.choice([1, 2, 25])):
            rows.append((len(rows), " ".join(w)))
            for _ in range(random.choice([1, 2, 3, 5])):
                w[random.randrange(len(w))] = f"new{random.random()}"
    base = prose(99, 120).split()
    for i in range(60):
        w = list(base)
        for j in random.sample(range(120), random.choice([2, 3, 4])):
            w[j] = f"other{i}"
        rows.append((len(rows), " ".join(w)))
    random.shuffle(rows)
    assert_components(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_sketches_are_full_and_estimate_similarity():
    random.seed(1)
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64))
    sets = [a[:1], a[:2], a[:40], a[:1000], a[100:1100], a[:0], a]
    starts = np.cumsum([0, *map(len, sets)])
    found = sketch_dedup.sketches(np.concatenate(sets), starts, bins=512)
    assert (found[5] == 0).all() and (np.delete(found, 5, axis=0) >> np.uint64(32) < 1024).all()
    # a set of one shingle fills its last coordinates in the rounds that choose them
    assert (found[0] >> np.uint64(32)).max() >= 512 and len(set(found[0].tolist())) > 300
    agree = (found[3] == found[4]).mean()
    assert abs(agree - 900 / 1100) < 0.06
    # alone and among others, a set has the same sketch
    alone = sketch_dedup.sketches(sets[2], np.array([0, 40]), bins=512)
    assert (alone[0] == found[2]).all()


def test_shingles_are_those_of_plain_python():
    texts = [*messy_texts(), "a b", "a  b", "A\tb\x0bC", "ab c", "a bc"]
    hashes, starts = sketch_dedup.shingle_sets(pa.array(texts, pa.string()))
    names = {}
    for s, a, b in zip(brute_sets(list(enumerate(texts))), starts[:-1], starts[1:]):
        assert len(s) == b - a
        for h in [frozenset(hashes[a:b].tolist())]:
            assert names.setdefault(h, s) == s
    assert len(names) == len({frozenset(s) for s in names.values()})
