"""Repository categories from topics and descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from starwake.functions.text import is_blank, list_or_empty, strip, text_or_empty
from starwake.vocab import (
    AI_SIGNAL_WORDS,
    CATEGORY_PHRASES,
    CATEGORY_TOPICS,
    LOOSE_CATEGORY_WORDS,
    OTHER,
)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda left, right: left | right, [F.contains(text, F.lit(w)) for w in words])


def _first_of(conditions: list[tuple[Column, str]]) -> Column:
    """Name of the first condition that holds."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in conditions])


def classify(topics: Column, description: Column) -> Column:
    """Exact topics first, then phrases of the description, then Other.

    A word list is one constant (split when the plan is made), which keeps plans that classify
    small.
    """
    return classify_lowered(topics, F.lower(text_or_empty(description)))


def classify_lowered(topics: Column, lowered: Column) -> Column:
    """The same for a text that is in lower case already; long texts are lowered only once."""
    clean = F.transform(list_or_empty(topics), lambda topic: strip(F.lower(topic)))
    by_topic = [
        (F.arrays_overlap(clean, F.split(F.lit(",".join(words)), ",")), name)
        for name, words in CATEGORY_TOPICS.items()
    ]
    by_phrase = [(contains_any(lowered, words), name) for name, words in CATEGORY_PHRASES.items()]
    return F.coalesce(_first_of(by_topic + by_phrase), F.lit(OTHER))


def classify_loose(topics: Column, description: Column, repo_name: Column) -> Column:
    """Any listed word anywhere in topics, description or name."""
    haystack = F.lower(
        F.concat_ws(
            " ",
            F.array_join(list_or_empty(topics), " "),
            text_or_empty(description),
            text_or_empty(repo_name),
        )
    )
    found = [(contains_any(haystack, words), name) for name, words in LOOSE_CATEGORY_WORDS.items()]
    return F.coalesce(_first_of(found), F.lit(OTHER))


def effective_category(stored: Column, topics: Column, description: Column) -> Column:
    """A stored Other is looked at again."""
    return F.when(stored == OTHER, classify(topics, description)).otherwise(stored)


def signal_text(
    description: Column,
    readme: Column,
    issue_titles: Column,
    readme_chars: int | None = None,
    max_titles: int | None = None,
) -> Column:
    """Description, README and issue titles as one text; limits cut the latter two."""
    readme_part = strip(text_or_empty(readme))
    if readme_chars is not None:
        readme_part = F.substring(readme_part, 1, readme_chars)
    titles = F.filter(
        F.transform(list_or_empty(issue_titles), strip), lambda title: ~is_blank(title)
    )
    parts = [
        strip(text_or_empty(description)),
        readme_part,
        F.array_join(titles if max_titles is None else F.slice(titles, 1, max_titles), " "),
    ]
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])


def ai_signal(category: Column, lowered: Column) -> Column:
    """A real category, or any of the listed words in the (lower-case) text."""
    return (category != OTHER) | contains_any(lowered, AI_SIGNAL_WORDS)
