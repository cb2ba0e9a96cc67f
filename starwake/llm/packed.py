"""Words of many texts at once, as numpy arrays over their bytes.

Used inside ``mapInPandas`` tasks. Texts are handled as UTF-8; a word's hash depends on its bytes
only, not on the process, so all executors agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Letters, digits and every byte of a code point beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others; one-to-one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mixed(np.arange(1, 257, dtype=U64) * U64(_BASE))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the next call."""
    if log_size in _POWERS:
        return _POWERS[log_size]
    pair = []
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(1 << log_size, factor, dtype=U64)
        steps[0] = 1
        pair.append(np.cumprod(steps))
    if log_size <= 22:
        _POWERS[log_size] = pair[0], pair[1]
    return pair[0], pair[1]


def slices(texts: Sequence[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, or of one longer text, to bound memory."""
    begin, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, at
            begin, held = at, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Words:
    """The words of some texts joined by newlines."""

    data: np.ndarray
    texts: np.ndarray  # first byte of each text, and the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray  # running sums of the bytes' codes times powers of the base
    inverse: np.ndarray

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of the words, 0 for words that are not longer."""
        longer = self.end - self.start > length
        end = np.where(longer, self.start + length, self.start)
        raw = (self.sums[end] - self.sums[self.start]) * self.inverse[self.start]
        return np.where(longer, mixed(raw ^ U64(length << 56)), U64(0))

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of all words."""
        return np.searchsorted(self.start, self.texts)


def find_words(texts: Sequence[bytes], inside: np.ndarray) -> Words:
    """The runs of bytes for which ``inside`` holds, with hashes in which A-Z count as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(text) + 1 for text in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    edge = np.flatnonzero(np.diff(inside[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    powers, inverse = _powers(max(16, int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_CODES[LOWER[data]] * powers[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return Words(data, bounds, start, end, mixed(raw + (end - start).astype(U64)), sums, inverse)


def encoded(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of texts, empty for null."""
    return [text.encode() if isinstance(text, str) else b"" for text in texts]


def code_points(text: bytes, at: Sequence[int]) -> list[int]:
    """The positions in code points of positions in bytes; one pass over the text for all of them."""
    if not at or text.isascii():
        return list(at)
    starts = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    return before[np.asarray(at, dtype=np.int64)].tolist()
