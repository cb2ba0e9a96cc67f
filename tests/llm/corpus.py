"""Small tables for the tests: documents with extra columns that clash with inner and result names."""

from __future__ import annotations

import random

CLASHING = (
    "_id bigint, _text string, _gone string, _tag string, score string, size string, start string, "
    "copies string, n_lines string, rank string, taken string, _copy string, labels string"
)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(*row, None)[:3] for row in rows]
    schema = f"doc_id bigint, text string, source string, {CLASHING}"
    return spark.createDataFrame([(*row, 7, *["x"] * 12) for row in full], schema)


def words(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghiklmnoprstuvwy", k=rng.randint(2, 8))) for _ in range(count)]


def result(df, key="doc_id"):
    return {row[key]: row for row in df.collect()}


BLANKS = " \t\n\x0b\x0c\r"


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_words(text: str | None) -> list[str]:
    """Words between the six white-space characters, A-Z lowered."""
    out, at = [], ""
    for c in low(text or ""):
        if c in BLANKS:
            out.append(at)
            at = ""
        else:
            at += c
    return [word for word in [*out, at] if word]
