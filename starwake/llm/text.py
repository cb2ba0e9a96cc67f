"""Column expressions shared by the operators that use only built-in functions.

White space is ``[\\x20\\x09-\\x0D]`` and only A-Z change when letters are lowered, so that results do
not depend on a locale.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t-\r]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered. Texts of ASCII only take the fast built-in, which does the same on them."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words of a text, an empty array for null, empty or blank texts."""
    core = stripped(F.coalesce(text, F.lit("")))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def n_words(text: Column) -> Column:
    core = stripped(F.coalesce(text, F.lit("")))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, BLANK_RUN))).cast("bigint")
