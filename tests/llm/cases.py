"""Rows that every operator over documents has to bear."""

from __future__ import annotations

LONG = "the quick brown fox and the lazy dog of the north " * 6000

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_out` string, `Text2` string, `_in0` string"


def documents(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46, "x", "y", "z"),
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46, "x", "y", "z"),
        (2, "The cat sat on the mat and looked at the moon.", "en", "b", 46, None, None, None),
        (3, "", "en", "a", 0, "x", "y", "z"),
        (4, None, "en", "a", None, "x", "y", "z"),
        (None, "A row without a number that has words of its own.", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG), "x", "y", "z"),
        (6, "x" * 300_000, "zz", "a", 300_000, "x", "y", "z"),
        (7, " \t\n  ", "en", "a", 5, "x", "y", "z"),
        (8, "Ünïcode é ́ 漢字 🙂 <|endoftext|> \x00 it's 12½", "de", "a", 30, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
