"""Text and number cleaning columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starwake.vocab import HOST_URL, QUERY_TERM

BLANKS = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def empty_list() -> Column:
    return F.array().cast("array<string>")


def list_or_empty(items: Column) -> Column:
    return F.coalesce(items, empty_list())


def repo_key(repo_name: Column) -> Column:
    """Repository names are case-insensitive; this is the form to group and join on."""
    return F.lower(repo_name)


def owner_of(repo_name: Column) -> Column:
    return F.split_part(repo_name, F.lit("/"), F.lit(1))


def short_name_of(repo_name: Column) -> Column:
    """Second part, ``''`` when there is none."""
    return F.split_part(repo_name, F.lit("/"), F.lit(2))


def snapshot_owner_of(repo_name: Column) -> Column:
    """History rows leave the owner empty for a name without a slash."""
    return F.when(F.contains(repo_name, F.lit("/")), owner_of(repo_name)).otherwise("")


def snapshot_short_name_of(repo_name: Column) -> Column:
    """History rows keep the whole name when it has no slash."""
    return F.when(F.contains(repo_name, F.lit("/")), short_name_of(repo_name)).otherwise(repo_name)


def page_url(repo_name: Column) -> Column:
    return F.concat(F.lit(HOST_URL), repo_name)


def clone_url(repo_name: Column) -> Column:
    return F.concat(page_url(repo_name), F.lit(".git"))


def whole_number(text: Column) -> Column:
    """Text to a whole number; whatever is not one counts as 0.

    JSON booleans arrive as ``true``/``false`` and JSON floats with a fraction, which is cut off.
    """
    cleaned = strip(text)
    lowered = F.lower(cleaned)
    fraction = F.when(
        F.rlike(cleaned, F.lit(r"^[+-]?\d+\.\d*([eE][+-]?\d+)?$")), cleaned.try_cast("double")
    ).try_cast("bigint")
    number = F.when(F.rlike(cleaned, F.lit(r"^[+-]?\d+$")), cleaned.try_cast("bigint"))
    flag = F.when(lowered == "true", F.lit(1)).when(lowered == "false", F.lit(0)).cast("bigint")
    return F.coalesce(number, flag, fraction, F.lit(0).cast("bigint"))


def flag_of(text: Column, default: bool) -> Column:
    """JSON truth of a text column: absent gives the default; null, false, 0 and '' are false."""
    return F.when(text.isNull(), F.lit(default)).otherwise(
        ~F.lower(strip(text)).isin("false", "0", "", "null")
    )


def search_document(
    full_name: Column,
    name: Column,
    owner: Column,
    language: Column,
    category: Column,
    topics: Column,
    description: Column,
    max_chars: int | None = None,
) -> Column:
    """The text a search looks at: the non-empty parts joined by blanks."""
    parts = [full_name, name, owner, language, category, F.array_join(topics, " "), description]
    joined = F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


def normalise_query(query: Column) -> Column:
    return F.regexp_replace(strip(F.lower(query)), r"\s+", " ")


def query_terms(query: Column) -> Column:
    """Terms of a query, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(QUERY_TERM), F.lit(0)))


def grouped(number: Column) -> Column:
    """1234567 as ``1,234,567``."""
    return F.format_number(number, 0)


def non_null(*items: Column) -> Column:
    """List of the given texts without those that are NULL."""
    return F.array_compact(F.array(*items))
