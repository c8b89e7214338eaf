"""Token counts from pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so the tokens of a text are the sum
over its pre-tokens. Pieces are counted once for each distinct pre-token of the corpus
by the tokenizer itself and joined to the pre-token frequencies of each document; no
ids are kept.

Pre-tokens are as skewed as words. The frequent ones, bounded in number and bytes, form
a broadcast table and are summed where the document is read; only the occurrences of the
rare ones are shuffled, so no join key is hot.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table, text_or_empty
from firnline.session import materialise

QUERY = "op6_token_counts"

# fixed values: Unicode white space, and the split pattern of byte-level BPE
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> list[str]:
    """Strings that the tokenizer cuts out before it splits; fails for a tokenizer of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("only plain byte-level tokenizers split texts into independent pre-tokens")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens with conditions are not supported")
    return [t["content"] for t in spec["added_tokens"]]


def pre_tokens(text: Column, added: list[str]) -> Column:
    """Array of the pre-tokens of ``text``; every added token is one of its own, in no particular place."""
    if not added:
        return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))
    parts = F.split(text, "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(added, key=len, reverse=True)))
    found = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(PRE_TOKEN), F.lit(0))))
    return F.concat(found, F.array_repeat(F.lit(added[0]), F.size(parts) - 1))


def piece_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for b in batches:
            encoded = tokenizer.encode_batch_fast(b.column("token").to_pylist(), add_special_tokens=False)
            pieces = pa.array([len(e) for e in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("seen"), pieces], ["token", "seen", "pieces"])

    return count


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """Every distinct pre-token of ``docs`` once: ``token, seen, pieces``."""
    tokens = docs.select(F.explode(pre_tokens(text_or_empty(), added_tokens(path))).alias("token"))
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    return seen.mapInArrow(piece_counter(path), "token string, seen bigint, pieces bigint")


def least_frequent(pieces: DataFrame, most: int, most_bytes: int) -> int:
    """Smallest frequency that at most ``most`` pre-tokens of ``most_bytes`` together reach, from a histogram of a few dozen bins."""
    bins = pieces.groupBy(F.floor(4 * F.log2("seen")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token").cast("bigint")).alias("bytes"), F.min("seen").alias("least")
    )
    total, size, least = 0, 0, None
    for row in sorted(bins.collect(), key=lambda r: -r.bin):
        total, size = total + row.n, size + row.bytes
        if total > most or size > most_bytes:
            break
        least = row.least
    return least if least is not None else 1 << 62


def token_counts(docs: DataFrame, path: str, frequent: int = 400_000, frequent_bytes: int = 16 << 20) -> DataFrame:
    """Bytes and tokens of each row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_bytes, n_tokens``.

    One row for each input row. NULL and empty texts have 0 bytes and 0 tokens; a NULL or
    repeated ``doc_id`` is no different from any other. ``frequent`` and
    ``frequent_bytes`` bound the rows and the bytes of the broadcast table and do not change the result. Other columns are not read.
    """
    pieces = materialise(piece_table(docs, path))
    least = least_frequent(pieces, frequent, frequent_bytes)
    common = pieces.where(F.col("seen") >= least).select("token", F.col("pieces").alias("known"))

    text = text_or_empty()
    # a row is known by its id and its text; rows that repeat both are counted and put back at the end
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.concat(F.array(F.lit(None).cast("string")), pre_tokens(text, added_tokens(path))).alias("tokens"),
    )
    keyed = rows.select("doc_id", "key", "n_bytes", F.explode("tokens").alias("token"))
    met = keyed.join(F.broadcast(common), "token", "left")
    rare = F.when(F.col("token").isNotNull() & F.col("known").isNull(), F.col("token"))
    frequencies = met.groupBy("doc_id", "key", rare.alias("rare")).agg(
        F.sum(F.when(F.col("token").isNull(), F.lit(0)).otherwise(F.col("known"))).alias("n"),
        F.max(F.when(F.col("token").isNull(), F.col("n_bytes"))).alias("n_bytes"),
        F.count(F.when(F.col("token").isNull(), 1)).alias("rows"),
        F.count(F.lit(1)).alias("times"),
    )
    # the summed part of a document meets nothing in this join; its id and text only spread it
    uncommon = pieces.where(F.col("seen") < least).select(F.lit(1).alias("side"), F.col("token").alias("met"), "pieces")
    sided = frequencies.withColumn("side", F.col("rare").isNotNull().cast("int")).withColumn(
        "met", F.coalesce("rare", F.xxhash64("doc_id", "key").cast("string"))
    )
    total = sided.join(uncommon, ["side", "met"], "left").groupBy("doc_id", "key").agg(
        F.sum(F.coalesce(F.col("n"), F.col("times") * F.col("pieces"))).alias("n"),
        F.max("n_bytes").alias("n_bytes"), F.sum("rows").alias("rows"),
    )
    each = total.withColumn("n_tokens", F.expr("n DIV rows"))
    return each.select("doc_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_")).drop("_")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


SQL = None
