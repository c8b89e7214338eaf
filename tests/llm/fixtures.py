"""Small tables and plain-Python versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns that operators might use for themselves.
CLASHING = (
    "row string, key string, digest string, token string, hash string, words string, n string, score string, word string,"
    " component string, k1 string, block string, th string, kept string, spans string, items string, held_out string, body string,"
    " locator string, edges string, slice string, _loser string, seen string, pieces string, ids string, host string, slots string"
)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    """``n`` distinct-looking words of letters."""
    return " ".join("".join(chr(97 + int(d)) for d in f"{seed:03d}{(i * 7919 + seed * 104729) % 1000003}") for i in range(n))


def messy_texts():
    base = prose(1, 60)
    return [
        None, "", " ", "\t\n", "Short one", "short  one", base, base, base.upper(), base + " tail", prose(2, 3), "é ß 日本語 😀 x",
        prose(3, 20_000), "a" * 5000, "<|endoftext|> in text", "!!! ... ???", prose(1, 59) + "\nother", "\x00nul\x1cfs",
    ]


def with_clashes(spark, rows, schema):
    """A table with many more columns than the operators read."""
    names = [c for c in CLASHING.split(", ") if c.split()[0] not in [s.split()[0] for s in schema.split(", ")]]
    return spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], ", ".join([schema, *names]))


def messy(spark):
    """NULL, empty, very long and repeated texts, NULL and repeated ids, clashing columns."""
    texts = messy_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "nobody's text"), (7, texts[7])]
    return with_clashes(spark, rows, "doc_id bigint, text string"), rows


def ids_key(x):
    return (x is None, x or 0)
