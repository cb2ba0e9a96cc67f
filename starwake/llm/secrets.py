"""Secret scans: fixed patterns, and strings that a primed zstandard model finds new."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm.packed import code_points, encoded

# Base patterns, over bytes; letters of "assign" in either case.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

# Identifiers and words of code that a string has to differ from to be new.
VOCABULARY = """
access account address admin api apikey api_key application argument array async auth authorization
await base64 basic bearer begin boolean bucket buffer build cache callback certificate class client
client_id client_secret code config configuration connect connection const constant content context
cookie create credential credentials data database debug default define delete description dev
dictionary digest domain email enable encoding encrypt endpoint env environment error example except
export expire extends false field file filter final float format function get grant hash header
host http https id identifier import index info init input insert int interface internal issue item
jdbc json key language length level license list load local localhost log login main manager map
master message method mode model module name namespace new null number object option order output
package page param parameter parent parse passphrase password path payload placeholder pool port
prefix primary private private_key process production property protected protocol proxy public query
read record redirect refresh region release remote remove replace request require response return
root sample scope script secret section secure select self server service session set setting
signature size sql ssh staging start static status storage string sub test text this throw time
timestamp title token true type undefined update url user username value var version void webhook
word write xxxxxxxx yaml your_api_key your_password your_secret your_token changeme 0123456789
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""

# Prose in front of every context, so that the cost of a word's letters is known in short contexts too.
PROSE = b"""The quick response of the service depends on where the request was made and how many people were waiting
for their answers at that time. Every account has an owner, who may change its settings, write to the public
lists, or ask the people of the help desk for another key. When nothing is known about a user, the system keeps
the last valid value and explains in a short message what should be done before the next attempt. Most questions
about responsibilities, organizations, international agreements and environmental development are answered under
their own headings; just a few have been left for further consideration. We could not judge whether all examples
would work without changes, though they compiled and passed their tests on several machines during the summer.
"""

#: Words that make the strings near them worth looking at.
SENSITIVE = re.compile(
    rb"password|passwd|passphrase|pwd|secret|token|api[_-]?key|credential|bearer|authorization|"
    rb"private[_-]?key|access[_-]?key|client[_-]?id",
    re.I,
)
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
CANDIDATE_BYTE = re.compile(rb"[A-Za-z0-9+/_=-]")
#: Bytes around a sensitive word in which strings are looked at, and context given to the model.
REACH = 120
#: Marginal compressed bytes a character from which a string counts as incompressible: words and
#: identifiers cost up to 0.85, random strings of both cases and digits 0.85 to 1.5.
NOVELTY = 0.86
#: The same for strings with digits among letters, as hexadecimal ones of fewer than 32 digits.
NOVELTY_DIGITS = 0.62

_QUICK = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


class Novelty:
    """Compressed bytes that a string adds to its context, with the vocabulary as dictionary."""

    def __init__(self) -> None:
        words = " ".join(VOCABULARY.split()).encode()
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(
            level=19, dict_data=primed, write_content_size=False, write_checksum=False
        )

    def rate(self, candidate: bytes, context: bytes) -> float:
        if candidate.isupper():
            candidate = candidate.lower()  # capitals alone are no news
        context = PROSE + context
        alone = len(self.packer.compress(context))
        return (len(self.packer.compress(context + candidate)) - alone) / len(candidate)


def _limit(text: bytes) -> float:
    digits = sum(48 <= byte < 58 for byte in text)
    return NOVELTY_DIGITS if 3 <= digits < len(text) else NOVELTY


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns in bytes, leftmost and without overlap within a kind."""
    spans = []
    low = text.lower()
    if any(word in low for word in _QUICK):
        spans += [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8
        ]
    if b"AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


def novel_spans(text: bytes, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Strings near sensitive words that the dictionary and the text around do not explain.

    Candidates come from left to right and each is looked at once; those that a base span overlaps
    are found by bisection in the joined base spans.
    """
    spans, seen = [], 0
    joined: list[list[int]] = []
    for start, end, _ in sorted(base):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    begins = [start for start, _ in joined]

    def covered(start: int, end: int) -> bool:
        at = bisect_right(begins, end - 1) - 1
        return at >= 0 and joined[at][1] > start

    for word in SENSITIVE.finditer(text):
        low, high = max(seen, word.start() - REACH), word.end() + REACH
        while low > seen and CANDIDATE_BYTE.match(text, low):
            low -= 1  # to the start of a string that begins before the reach
        for found in CANDIDATE.finditer(text, low, min(high, len(text))):
            start, end = found.span()
            if found.end() == high:  # goes on beyond the reach
                end = CANDIDATE.match(text, start).end()
            seen = max(seen, end)
            if covered(start, end):
                continue
            context = text[max(0, start - REACH) : start] + text[end : end + REACH]
            if novelty.rate(text[start:end], context) >= _limit(text[start:end]):
                spans.append((start, end, "novel"))
    return spans


def scan(text: bytes, novelty: Novelty) -> dict:
    base = base_spans(text)
    added = novel_spans(text, base, novelty)
    counts = {f"n_{kind}": sum(k == kind for _, _, k in base) for kind in KINDS[:3]}

    def listed(spans: list[tuple[int, int, str]]) -> str:
        ordered = sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))
        places = code_points(text, [place for a, b, _ in ordered for place in (a, b)])
        return ",".join(f"{k}:{places[2 * at]}:{places[2 * at + 1]}" for at, (_, _, k) in enumerate(ordered))

    return counts | {
        "base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(),
        "spans": listed(base + added),
    }


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def secret_findings(text: Column) -> Column:
    """A struct of the findings in a text; see :func:`scan_secrets`."""

    @F.pandas_udf(SCHEMA)
    def scanned(column: pd.Series) -> pd.DataFrame:
        novelty = Novelty()
        fields = [field.split()[0] for field in SCHEMA.split(", ")]
        return pd.DataFrame([scan(one, novelty) for one in encoded(column)], columns=fields)

    return scanned(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every row: counts of the fixed patterns, a digest of their spans, and all spans.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then kind. Besides
    the fixed patterns, strings of 16 characters or more near a sensitive word are ``novel`` if
    appending them to the text around costs at least ``NOVELTY`` compressed bytes a character
    (``NOVELTY_DIGITS`` with three digits or more among other characters), with a dictionary of code
    words given to the compressor. Random strings of letters of one case cost little more than words,
    so most of them are not told apart.

    A null or empty text has no findings. A very long text is scanned whole, in time in proportion to
    its length and number of candidates. Repeated rows are scanned each; other columns are not
    returned. An empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), secret_findings(F.col(text_col)).alias("_found"))
    return found.select("doc_id", "_found.*")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with all found spans replaced, overlapping ones as one; null texts stay null."""

    @F.pandas_udf("string")
    def masked(column: pd.Series) -> pd.Series:
        novelty, out = Novelty(), []
        for text, data in zip(column, encoded(column)):
            base = base_spans(data)
            parts, at = [], 0
            for start, end, _ in sorted(base + novel_spans(data, base, novelty)):
                if start >= at:
                    parts += [data[at:start], mask.encode()]
                at = max(at, end)
            out.append(text if not parts else b"".join([*parts, data[at:]]).decode())
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))
