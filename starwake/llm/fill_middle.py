"""Fill-in-the-middle: texts cut into prefix, middle and suffix at token boundaries.

Cuts are drawn as ranks of tokens. A learned index of a text's boundaries maps a rank to its offset:
a line per segment predicts the offset within an error, and the stored residual makes it exact.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm.columns import plain, plain_name
from starwake.llm.packed import slices

#: Largest difference of a line from an offset, so that rounded residuals fit one byte.
ERROR = 126
#: Boundaries looked at first when a segment is extended; the number doubles up to the second.
LOOK, MOST_LOOK = 64, 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
#: Of 100 documents that are not empty, those made into examples, and of 100 examples those that
#: begin with the suffix.
MADE, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_TRAILING = np.zeros(256, dtype=bool)
_TRAILING[0x80:0xC0] = True


@dataclass
class RankIndex:
    """Offsets of a text's boundaries by rank: lines over ranges of ranks, and residuals."""

    rank: np.ndarray  # first rank of each segment
    offset: np.ndarray  # its offset
    slope: np.ndarray
    residual: np.ndarray  # of every rank, one byte each

    @classmethod
    def fit(cls, bounds: np.ndarray, error: int = ERROR) -> RankIndex:
        """Each segment is as long as one line from its first boundary stays within ``error`` of all.

        The cone of slopes that are still allowed narrows from boundary to boundary. A segment ends
        early only after at least ``error`` bytes, so the work is in proportion to the text.
        """
        ranks, slopes = [], []
        start, count = 0, len(bounds)
        while start < count:
            low, high, end, look = 0.0, np.inf, start + 1, LOOK
            while end < count:
                part = bounds[end : end + look] - bounds[start]
                steps = np.arange(end - start, end - start + len(part))
                lows = np.maximum(np.maximum.accumulate((part - error) / steps), low)
                highs = np.minimum(np.minimum.accumulate((part + error) / steps), high)
                closed = lows > highs
                fits = int(closed.argmax()) if closed.any() else len(part)
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                end += fits
                if fits < len(part):
                    break
                look = min(2 * look, MOST_LOOK)
            ranks.append(start)
            slopes.append((low + high) / 2 if end > start + 1 else 0.0)
            start = end
        rank, slope = np.array(ranks, dtype=np.int64), np.array(slopes)
        offset = bounds[rank]
        of = np.repeat(np.arange(len(rank)), np.diff(rank, append=count))
        guess = offset[of] + np.floor(slope[of] * (np.arange(count) - rank[of]) + 0.5).astype(np.int64)
        return cls(rank, offset, slope, (bounds - guess).astype(np.int8))

    def predicted(self, rank: int) -> int:
        of = bisect_right(self.rank, rank) - 1
        return int(self.offset[of] + np.floor(self.slope[of] * (rank - self.rank[of]) + 0.5))

    def at(self, rank: int) -> int:
        """The exact offset of a boundary."""
        return self.predicted(rank) + int(self.residual[rank])


def boundaries(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text, the offsets in bytes at which tokens begin, and its end.

    A token is a run of ASCII letters, or any other code point.
    """
    for begin, end in slices(texts):
        part = texts[begin:end]
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        edges = np.cumsum([0] + [len(text) + 1 for text in part])
        letter = _LETTER[data]
        first = ~_TRAILING[data]
        first[1:] &= ~(letter[1:] & letter[:-1])
        first[edges[:-1]] = True  # the newline behind each text is the place of its end
        found = np.flatnonzero(first)
        cuts = np.searchsorted(found, edges)
        for at in range(len(part)):
            yield found[cuts[at] : cuts[at + 1]] - edges[at]


def draws(name: object, seed: int) -> list[int]:
    """The first four numbers of 32 bits in the SHA-256 of ``<seed>:<id>``."""
    text = "" if name is None else str(name)
    digest = hashlib.sha256(f"{seed}:{text}".encode()).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in range(0, 16, 4)]


def n_points(data: bytes) -> int:
    """Code points in UTF-8."""
    return len(data) - int(np.count_nonzero(_TRAILING[np.frombuffer(data, dtype=np.uint8)]))


_MADE = (
    "_n bigint, _form string, _prefix_chars bigint, _middle_chars bigint, _segments int, _output binary"
)


def _making(seed: int, made: int, suffix_first: int, error: int):
    def example(name: object, text: bytes, bounds: np.ndarray) -> tuple:
        n = len(bounds) - 1
        h1, h2, h3, h4 = draws(name, seed)
        index = RankIndex.fit(bounds, error)
        if not text or any(mark in text for mark in MARKS) or h3 % 100 >= made:
            return n, "plain", None, None, len(index.rank), text
        low, high = sorted((index.at(h1 % (n + 1)), index.at(h2 % (n + 1))))
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        if h4 % 100 < suffix_first:
            form, parts = "spm", (MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle)
        else:
            form, parts = "psm", (MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle)
        return n, form, n_points(prefix), n_points(middle), len(index.rank), b"".join(parts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _MADE.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            texts = [text or b"" for text in batch.column("_text").to_pylist()]
            ids = batch.column("_name").to_pylist()
            rows = [
                example(name, text, bounds)
                for name, text, bounds in zip(ids, texts, boundaries(texts), strict=True)
            ]
            others = [at for at, name in enumerate(batch.schema.names) if name not in ("_text", "_name")]
            columns = [batch.column(at) for at in others]
            for at, kind in enumerate(kinds):
                columns.append(pa.array([row[at] for row in rows], kind))
            yield pa.record_batch(columns, names=[batch.schema.names[at] for at in others] + names)

    return make


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    made: int = MADE,
    suffix_first: int = SUFFIX_FIRST,
    error: int = ERROR,
) -> DataFrame:
    """Examples for filling in the middle, one per document.

    A row per row of ``docs``: the id under its own name, ``n`` tokens, ``form``, ``prefix_chars``
    and ``middle_chars`` in code points (null if plain), ``n_segments`` of the index, and ``output``.

    The two cuts are ranks drawn from the SHA-256 of ``<seed>:<id>``; the index of the text's
    boundaries gives their offsets. ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle and
    ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A document stays as it is (``plain``)
    if it is empty, holds a mark, or is drawn to.

    Null texts are empty ones. A null id is drawn as an empty text. Repeated rows give the same
    example each. An empty table gives an empty result. Other columns are not read, whatever their
    names. Very long texts take time and memory in proportion to their length: the index has one
    byte a token, and nothing is compared with the whole text.

    No shuffle. Tasks work on the bytes of a batch at once, in slices of a quarter of a megabyte.
    """
    rows = plain(docs.select(id_col, text_col)).select(
        "c0", F.col("c0").cast("string").alias("_name"), F.col("c1").cast("binary").alias("_text")
    )
    kind = dict(docs.dtypes)[id_col]
    found = rows.mapInArrow(_making(seed, made, suffix_first, error), f"c0 {kind}, {_MADE}")
    return found.select(
        F.col("c0").alias(id_col),
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix_chars").alias("prefix_chars"),
        F.col("_middle_chars").alias("middle_chars"),
        F.col("_segments").alias("n_segments"),
        F.col("_output").cast("string").alias("output"),
    )


def restored_text(output: Column, form: Column) -> Column:
    """The text an example was made of. Its parts hold no marks, so marks split it."""
    parts = F.split(output, "<[PSM]>", 4)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def rank_indexes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR
) -> DataFrame:
    """The learned index of each text, to store: id, ``n`` tokens, ``segments`` (rank, offset,
    slope) and ``residuals``, one signed byte a boundary. Offsets are in bytes of UTF-8."""
    kind = dict(docs.dtypes)[id_col]
    rows = plain(docs.select(id_col, text_col)).select("c0", F.col("c1").cast("binary").alias("_text"))
    segment = pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or b"" for text in batch.column("_text").to_pylist()]
            found = [RankIndex.fit(bounds, error) for bounds in boundaries(texts)]
            lines = [
                [
                    {"rank": rank, "offset": offset, "slope": slope}
                    for rank, offset, slope in zip(
                        one.rank.tolist(), one.offset.tolist(), one.slope.tolist(), strict=True
                    )
                ]
                for one in found
            ]
            columns = [
                batch.column("c0"),
                pa.array([len(one.residual) - 1 for one in found], pa.int64()),
                pa.array(lines, pa.list_(segment)),
                pa.array([one.residual.tobytes() for one in found], pa.binary()),
            ]
            yield pa.record_batch(columns, names=["c0", "n", "segments", "residuals"])

    schema = f"c0 {kind}, n bigint, segments array<struct<rank: bigint, offset: bigint, slope: double>>, residuals binary"
    return rows.mapInArrow(index, schema).withColumnRenamed("c0", id_col)
