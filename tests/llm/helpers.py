"""Odd tables, and plain versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, score string, kept string, doc string, tid string, hash string, sample string, spans string, label string"
)
EXTRA = ("x",) * 9

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
PLAIN = " ".join(f"the word{i} of a line" for i in range(30))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, PLAIN, "en", "a", 5),
        (2, None, "en", "a", None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", None, None, 4),
        (5, LONG, "xx", "b", len(LONG)),
        (6, PLAIN, "en", "a", 5),
        (6, PLAIN, "en", "a", 5),
        (None, PLAIN + " more", "de", None, 9),
        (None, None, None, None, None),
        (2**62 + 1, "large ids stay whole", "en", "a", 20),
        (7, "é日本 😀 z 'quote' <|endoftext|>", "fr", "é", 3),
        (8, "password = hunter22 and token: abc", "es", "a", 7),
        (9, PLAIN.replace("word3 ", "changed "), "en", "b", 5),
    ]
    return [(*r, *EXTRA) for r in rows]


def odd_documents(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else odd_rows(), SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str) -> Counter:
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
