"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon of abusive words and word stems is learned from labelled rows. The classes of
the words of a clause then run through a chain of transducers, one each for negation,
reported speech and target, that are composed into one machine; it marks every insult or
threat with its pattern: negated, reported, aimed at somebody. A clause scores by its
word and its pattern, a document by its clauses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import crc_mod, read_table
from firnline.llm.rows import release, releasing
from firnline.session import materialise

QUERY = "op1_toxicity"

#: Labelled rows that the lexicon is learned from, about, and entries that it may have.
SAMPLE_ROWS, MOST_ENTRIES = 20_000, 5_000
STEMS = (4, 5, 6)
#: Evidence (G2) and share of toxic texts that an entry needs, so that chance alone makes none.
LEAST_EVIDENCE, LEAST_PRECISION = 40.0, 0.5
THRESHOLD = 0.3

# closed-class words of the grammar, in four languages
NEGATION = frozenset("not no never neither nor cannot nicht kein keine keinen nie niemals ne pas jamais aucun ni nunca jamás ningún tampoco".split())
REPORT = frozenset(
    "said says say told called calls claims claimed wrote quote quoted sagte sagt schrieb nannte behauptet"
    " dit disait affirme appelle écrit dijo dice llamó escribió afirma".split()
)
TARGET = frozenset("you your youre he she they him her them du dich dein ihr euch sie tu toi te vous ton usted tú ti ellos ustedes".split())
THREAT = frozenset("kill killing murder stab shoot strangle töten umbringen ermorden erschießen tuer égorger assassiner matar asesinar apuñalar".split())

_WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.,;:!?\n]+")
#: Shares assumed for a pattern before any was seen, as heavy as so many clauses.
PRIOR_CLAUSES = 20


@dataclass
class Transducer:
    """Deterministic transducer: ``step[state, symbol] = (output, next state)``; state 0 starts."""

    step: dict[tuple[int, str], tuple[str, int]] = field(default_factory=dict)

    def compose(self, then: Transducer) -> Transducer:
        """The machine that feeds every output of this one to ``then``."""
        states, queue, made = {(0, 0): 0}, [(0, 0)], Transducer()
        symbols = {s for _, s in self.step}
        for a, b in queue:
            for s in symbols:
                middle, a2 = self.step[a, s]
                out, b2 = then.step[b, middle]
                if (a2, b2) not in states:
                    states[a2, b2] = len(states)
                    queue.append((a2, b2))
                made.step[states[a, b], s] = (out, states[a2, b2])
        return made

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            o, state = self.step[state, s]
            out.append(o)
        return out


#: Word classes; a marked insult or threat carries marks behind it, e.g. ``I-`` for a negated insult.
PLAIN = ["W", "N", "R", "Y"]


def marker(opens: str, mark: str, reach: int | None, hits: list[str], others: list[str]) -> Transducer:
    """Marks every hit within ``reach`` words behind ``opens``, or anywhere behind it if there is no reach."""
    t, last = Transducer(), 1 if reach is None else reach
    for state, s in product(range(last + 1), hits + others):
        after = state if reach is None else max(0, state - 1)
        if s == opens:
            t.step[state, s] = (s, last)
        elif s in hits:
            t.step[state, s] = (s + mark if state else s, after)
        else:
            t.step[state, s] = (s, after)
    return t


def grammar() -> Transducer:
    """Negation, then reported speech, then target, over words, insults ``I`` and threats ``T``."""
    hits = ["I", "T"]
    machine = marker("N", "-", 3, hits, PLAIN)
    hits = hits + [h + "-" for h in hits]
    machine = machine.compose(marker("R", "'", None, hits, PLAIN))
    hits = hits + [h + "'" for h in hits]
    return machine.compose(marker("Y", "+", 4, hits, PLAIN))


def assumed(pattern: str) -> float:
    """Share of toxic texts expected of a pattern that no labelled row shows."""
    share = 0.9 if "+" in pattern else 0.8 if pattern[0] == "I" else 0.4
    return share * (0.3 if "-" in pattern else 1.0) * (0.5 if "'" in pattern else 1.0)


def features(text: str) -> set[tuple[str, str]]:
    """Words, each with the words at both its sides, and with a star the stems of longer words, each with its word."""
    words = _LETTERS.findall(text.lower())
    found = set()
    for left, w, right in zip(["", *words], words, [*words[1:], ""]):
        found.add((w, f"{left} {right}"))
        found.update((w[:n] + "*", w) for n in STEMS if len(w) > n)
    return found


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    patterns: dict[str, float]
    base: float

    def __post_init__(self) -> None:
        self.machine = grammar()

    def entry(self, word: str) -> float:
        """Share of toxic texts among those with this word, 0 if it has no entry."""
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])

    def concerns(self, text: str) -> bool:
        words = set(_LETTERS.findall(text.lower()))
        return not (
            self.words.keys().isdisjoint(words) and THREAT.isdisjoint(words)
            and (not self.stems or all(self.stems.keys().isdisjoint({w[:n] for w in words if len(w) > n}) for n in STEMS))
        )

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """Pattern and share of the strongest word of every clause that has an insult or threat."""
        for clause in _CLAUSE.split(text.lower()):
            tokens = _WORD.findall(clause)
            if not tokens:
                continue
            shares = [self.entry(t) for t in tokens]
            symbols = [
                "I" if share else "T" if t in THREAT else "N" if t in NEGATION else "Y" if t in TARGET
                else "R" if t in REPORT or not t[0].isalpha() else "W"
                for t, share in zip(tokens, shares)
            ]
            if "I" in symbols or "T" in symbols:
                marked = zip(self.machine.run(symbols), shares)
                yield max(((s, share or 1.0) for s, share in marked if s[0] in "IT"), key=lambda x: x[1] * self.patterns.get(x[0], assumed(x[0])))

    def score(self, text: str | None) -> float:
        if not text or not self.concerns(text):
            return self.base
        clean = 1.0 - self.base
        for pattern, share in self.clauses(text):
            clean *= 1.0 - share * self.patterns.get(pattern, assumed(pattern))
        return 1.0 - clean


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` labelled texts by a hash of their id, one for each family of near copies: ``text, toxic``."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    met = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # texts that share their smallest hash of three words are taken for copies of each other
    w = F.split(F.lower("text"), r"\s+")
    family = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, 3))))
    kept = met.withColumn("w", w).withColumn("family", family).groupBy("family", "toxic").agg(F.min_by("text", "doc_id").alias("text"))
    return kept.select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and pattern shares from the labelled rows of ``docs``."""
    sample = materialise(labelled_sample(docs, labels))

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, clean, places = Counter(), Counter(), set()
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found = features(text)
                if label == 1:
                    toxic.update({f for f, _ in found})
                    places |= found
                else:
                    clean.update({f for f, _ in found})
            yield _counts(toxic, clean)
            yield _counts(Counter(), Counter(), list(places))

    seen = sample.mapInArrow(releasing(count_features), _COUNTS)
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    chosen: list = []
    if n_toxic and n_clean:
        # copies of a text repeat its words in the same places, and a stem of one word is no stem
        placed = seen.groupBy("feature", "place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        summed = placed.groupBy("feature").agg(
            F.least(F.sum("toxic"), F.count("place")).alias("toxic"), F.sum("clean").alias("clean")
        ).where("toxic >= 5")
        strong = summed.where((_evidence(n_toxic, n_clean) >= LEAST_EVIDENCE) & (_precision() >= LEAST_PRECISION))
        chosen = strong.orderBy(F.desc(F.col("toxic") * _precision()), "feature").limit(MOST_ENTRIES).collect()
    shares = {r.feature: (r.toxic + 0.5) / (r.toxic + r.clean + 1.0) for r in chosen}
    model = Model(
        {k: v for k, v in shares.items() if k[-1] != "*"}, {k[:-1]: v for k, v in shares.items() if k[-1] == "*"}, {}, 0.0
    )

    def count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                patterns = [p for p, _ in model.clauses(text)] if model.concerns(text) else []
                (toxic if label == 1 else clean).update(patterns or [""])
        yield _counts(toxic, clean)

    found = sample.mapInArrow(releasing(count_patterns), _COUNTS)
    rows = found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    for r in rows:
        prior = assumed(r.feature) if r.feature else 0.0
        share = (r.toxic + PRIOR_CLAUSES * prior) / (r.toxic + r.clean + PRIOR_CLAUSES)
        if r.feature:
            model.patterns[r.feature] = share
        else:
            model.base = min(share, THRESHOLD / 2)
    return model


_COUNTS = "feature string, place string, toxic bigint, clean bigint"


def _counts(toxic: Counter, clean: Counter, places: list[tuple[str, str]] | None = None) -> pa.RecordBatch:
    """Texts of each class by feature or, with ``places``, the places alone."""
    rows = [(f, None, toxic[f], clean[f]) for f in toxic.keys() | clean.keys()] if places is None else [(f, p, 0, 0) for f, p in places]
    columns = list(zip(*rows)) if rows else [()] * 4
    types = pa.string(), pa.string(), pa.int64(), pa.int64()
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["feature", "place", "toxic", "clean"])


def _precision() -> Column:
    return (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1.0)


def _evidence(n_toxic: int, n_clean: int) -> Column:
    """G2 of a feature with its texts split as seen against the split of all texts."""
    p = n_toxic / (n_toxic + n_clean)
    n = F.col("toxic") + F.col("clean")
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * F.lit(share)))).otherwise(0.0)
    return 2 * (part(F.col("toxic"), p) + part(F.col("clean"), 1 - p))


def scorer(model: Model):
    """Column function of a text: its score between 0 and 1."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")
            del batch
            release()
            release()

    return score


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score``, the chance that the text is toxic.

    Texts without an insult or threat, NULL and empty ones among them, score as such texts
    do in the labelled rows, always under the threshold. Whole texts are read; every row is
    judged by its text alone, so repeated rows, NULL ids and other columns play no part. A
    column ``score`` of ``docs`` is replaced.
    """
    return docs.withColumn("score", scorer(model)("text"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    return docs.where(scorer(model)("text") < threshold)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that labels may be learned from."""
    return docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(training_rows(docs), training_rows(read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    return toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


SQL = None
