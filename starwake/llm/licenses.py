"""Licence scans: Aho-Corasick over normalised words, and identifier expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm.packed import LETTER, LOWER, encoded

# Base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notice phrases in lower-case words, the label each stands for, and how far it decides (0 to 1).
NOTICES = {
    "apache license": ("apache", 0.7),
    "apache license version 2 0": ("apache-2.0", 1.0),
    "licensed under the apache license": ("apache", 1.0),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 1.0),
    "redistribution and use in source and binary forms": ("bsd", 1.0),
    "bsd license": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "isc license": ("isc", 0.8),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "general public license version 2": ("gpl-2.0", 1.0),
    "general public license version 3": ("gpl-3.0", 1.0),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.9),
    "all rights reserved": ("reserved", 0.6),
    "cc by": ("cc-by", 0.8),
    "general public license": ("gpl", 0.8),
}
TAG = "spdx license identifier"

# Licence identifiers that stand alone, heads of those that go on with a version or
# variant, and how identifiers of exceptions end.
ALONE = frozenset(
    "0bsd aml beerware curl fsfap ftl hpnd ijg imagemagick info-zip intel isc jasper libpng libtiff mirros "
    "mit mit-0 mulanpsl naist-2003 ncsa netcdf nlpl ntp openssl plexus psfrag rsa-md sax-pd smppl tcl "
    "ttwl unlicense vim w3c wtfpl x11 xinetd xnet zed zlib".split()
)
HEADS = (
    "afl agpl apache apsl artistic bittorrent blueoak bsd bsl busl cal catosl cc cc-by cc-by-nc cc-by-nc-nd "
    "cc-by-nc-sa cc-by-nd cc-by-sa cc-pddc cc0 cddl cdla cecill cern-ohl cpal cpl ecl efl elastic epl etalab "
    "eupl gfdl gpl lal lgpl lppl mit mpl ms mulanpsl nasa nbpl odbl odc-by ofl ogl oldap osl pddl php postgresql "
    "psf python qpl rpl ruby sgi-b sissl sleepycat spl sspl unicode upl w3c zpl"
).split()
EXCEPTION = "exception"

_VARIANT = re.compile(rf"(?:{'|'.join(sorted(HEADS, key=len, reverse=True))})(?:-[a-z0-9.]+)*?-?[0-9][a-z0-9.-]*\+?")
_REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_SPACED = np.where(LETTER, LOWER, 32).astype(np.uint8).tobytes()
_EXPRESSION = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-:]+")
_BINDING = {"or": 1, "and": 2, "with": 3}


def is_identifier(word: str, exception: bool = False) -> bool:
    """Whether a lower-case word names a licence (or an exception, behind ``with``)."""
    if _REFERENCE.fullmatch(word):
        return True
    if exception:
        return EXCEPTION in word.split("-")
    plain = word.removesuffix("+").removesuffix("-or-later").removesuffix("-only")
    return plain in ALONE or _VARIANT.fullmatch(word) is not None


def _goes_on(tokens: list[str], at: int, operator: str) -> bool:
    """Whether an operand stands behind an operator, maybe in parentheses."""
    while at < len(tokens) and tokens[at] == "(" and operator != "with":
        at += 1
    return at < len(tokens) and is_identifier(tokens[at].lower(), operator == "with")


def parse_expression(text: str) -> list[str] | None:
    """The expression in postfix order by the shunting-yard method, or None if it is not one.

    ``with`` binds before ``and``, ``and`` before ``or``; operators may be in either case. Operands
    are known identifiers and references; the expression ends before any other word, and before an
    operator that no operand follows.
    """
    output: list[str] = []
    held: list[str] = []
    operand_next = True
    opened, tokens = 0, _TOKEN.findall(text)
    for at, token in enumerate(tokens):
        word = token.lower()
        if word in _BINDING:
            if operand_next:
                return None
            if not _goes_on(tokens, at + 1, word):
                break
            while held and held[-1] != "(" and _BINDING[held[-1]] >= _BINDING[word]:
                output.append(held.pop())
            held.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            held.append(token)
            opened += 1
        elif token == ")":
            if operand_next or not opened:
                return None
            while held[-1] != "(":
                output.append(held.pop())
            held.pop()
            opened -= 1
        else:
            if not operand_next:
                break  # prose after the expression
            if not is_identifier(word, bool(held) and held[-1] == "with"):
                return None
            output.append(word)
            operand_next = False
    if operand_next:
        return None
    while held:
        if held[-1] == "(":
            return None
        output.append(held.pop())
    return output


def is_satisfied(postfix: list[str], accepted: frozenset[str]) -> bool:
    """Whether accepting these licences is enough: ``or`` takes either side, ``and`` needs both, and a
    licence ``with`` an exception counts if it is accepted as such or without the exception."""
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token not in _BINDING:
            stack.append((token in accepted, token))
            continue
        (right, exception), (left, name) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left or f"{name} with {exception}" in accepted, f"{name} with {exception}"))
        else:
            stack.append(((left or right) if token == "or" else (left and right), ""))
    return stack.pop()[0]


def evaluate_expression(postfix: list[str]) -> Iterator[list[str]]:
    """The choices an expression leaves, one after the other: each a sorted list of licences that hold
    together. There may be very many, so a caller takes as many as it needs."""

    def choices(at: int) -> tuple[Iterator[frozenset[str]], int]:
        """Choices of the part that ends at a place, and the place before it."""
        token = postfix[at]
        if token not in _BINDING:
            return iter([frozenset([token])]), at - 1
        right, middle = choices(at - 1)
        left, before = choices(middle)
        if token == "or":
            return chain(left, right), before
        if token == "with":
            extra, name = next(right), next(left)
            return iter([frozenset([f"{min(name)} with {min(extra)}"])]), before
        return (a | b for a in left for b in choices(at - 1)[0]), before

    seen: set[frozenset[str]] = set()
    for one in choices(len(postfix) - 1)[0]:
        if one not in seen:
            seen.add(one)
            yield sorted(one)


def _names(postfix: list[str]) -> list[str]:
    """The licences of an expression; one ``with`` an exception is named with it."""
    out: list[str] = []
    for token in postfix:
        if token == "with":
            exception = out.pop()
            out.append(f"{out.pop()} with {exception}")
        elif token not in _BINDING:
            out.append(token)
    return out


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes, automaton: ahocorasick.Automaton) -> dict:
    """Findings of one text."""
    words = text.translate(_SPACED).split()
    row = dict.fromkeys(("first_word", "last_word"))
    row |= {"n_words": len(words), "n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    spaced = b" %b " % b" ".join(words)
    line, blanks = spaced.decode("latin-1"), None
    base, labels, doubt, starts, tagged, places = set(), set(), 1.0, [], False, []
    for end, phrase in automaton.iter(line):
        if phrase == TAG:
            tagged = True
            continue
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(spaced, dtype=np.uint8) == 32)
        start = int(np.searchsorted(blanks, end - len(phrase) - 1))
        if phrase in BASE_PHRASES:
            row["n_base"] += 1
            starts.append(start)
            base.add(BASE_PHRASES[phrase])
        label, weight = NOTICES[phrase]
        labels.add(label)
        doubt *= 1 - weight * 0.95
        places.append({"phrase": phrase, "label": label, "word": start})
    expressions = []
    if tagged:
        for found in _EXPRESSION.finditer(text):
            postfix = parse_expression(found[1].decode(errors="replace"))
            if postfix is not None:
                expressions.append(" ".join(postfix))
                labels.update(_names(postfix))
                doubt *= 0.02
    if starts:
        row |= {"first_word": min(starts), "last_word": max(starts)}
    row["base_labels"] = ",".join(sorted(base))
    row["labels"] = ",".join(sorted(base | labels))
    row["score"] = 1 - doubt
    row["places"] = places
    row["expressions"] = expressions
    return row


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, places array<struct<phrase: string, label: string, word: bigint>>, "
    "expressions array<string>"
)


def license_findings(text: Column) -> Column:
    """A struct of the findings in a text; see :func:`scan_licenses`."""

    @F.pandas_udf(SCHEMA)
    def scanned(column: pd.Series) -> pd.DataFrame:
        automaton = _automaton()
        frame = pd.DataFrame([scan(one, automaton) for one in encoded(column)], columns=_FIELDS)
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scanned(text)


_FIELDS = (
    "n_words n_base first_word last_word base_labels labels score places expressions".split()
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence findings of every row.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered. One pass of an
    Aho-Corasick automaton finds base phrases, further notice phrases and identifier tags at all
    their places, overlapping ones included. The expression behind a tag is parsed; ``expressions`` has
    it in postfix order, for :func:`is_satisfied` and :func:`evaluate_expression`, and its licences
    are labels. ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` count
    base phrases only; ``labels`` has all; ``score`` is the noisy-or of the findings' weights, 0
    without any.

    A null or empty text has no words and no findings. A very long text is scanned whole, in time in
    proportion to its length and findings. Repeated rows are scanned each; other columns
    are not returned. An empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), license_findings(F.col(text_col)).alias("_found"))
    return found.select("doc_id", "_found.*")
