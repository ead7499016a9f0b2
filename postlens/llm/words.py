"""Vectorised words, word hashes and character n-grams of many texts at once.

Texts are laid out one after the other as code points, a blank before and after each.
Work goes by chunks of bounded size.  A longer text is cut between words into pieces;
a piece exceeds the size only if one word does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Code points in one chunk; a chunk needs some 60 bytes for each.
CHUNK = 1 << 17
_BLANKS = " \t\n\v\f\r"
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


class Chunk(NamedTuple):
    """``points`` are the code points, ``blank`` marks separators, ``starts`` has where
    each piece begins, ``owner`` which text it belongs to."""

    points: np.ndarray
    blank: np.ndarray
    starts: np.ndarray
    owner: np.ndarray


def chunks(texts: Iterable[str], overlap: int = 0, size: int = CHUNK) -> Iterator[Chunk]:
    """All texts in order.  A piece of a cut text repeats the last ``overlap`` words
    of the piece before it."""
    pieces: list[str] = []
    owner: list[int] = []
    room = size
    for k, text in enumerate(texts):
        for piece in _pieces(text, overlap, size) if len(text) > size else (text,):
            if pieces and len(piece) > room:
                yield _chunk(pieces, owner)
                pieces, owner, room = [], [], size
            pieces.append(piece)
            owner.append(k)
            room -= len(piece) + 1
    if pieces:
        yield _chunk(pieces, owner)


def _pieces(text: str, overlap: int, size: int) -> Iterator[str]:
    def last_blank(start: int, end: int) -> int:
        return max(text.rfind(c, start, end) for c in _BLANKS)

    several = re.compile(rf"(?>[{_BLANKS}]*[^{_BLANKS}]+){{{overlap + 1}}}")
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            # More words than the next piece repeats, and no part of a word.
            least = several.match(text, start)
            end = max(last_blank(start + 1, end), least.end() if least else len(text))
        yield text[start:end]
        if end == len(text):
            return
        back = end
        words = 0
        while words < overlap and back > start:
            cut = last_blank(start, back)
            words += cut + 1 < back
            back = max(cut, start)
        start = back if back > start else end


def _chunk(pieces: list[str], owner: list[int]) -> Chunk:
    joined = " " + " ".join(pieces) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    return Chunk(points, blank, starts, np.array(owner, np.int64))


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


#: Powers of ODD and of its inverse by length; filled in a worker, as far as one chunk needs.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        _POWERS.clear()
        _POWERS[n] = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (ODD, inverse)
        )
    return _POWERS[n]


class Words(NamedTuple):
    """Words of a chunk: where they begin and end, their piece, and sums for hashing."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self, length: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``length`` characters."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        raw = (self.sums[end] - self.sums[self.start]) * self.inverse[self.start]
        return mix(raw + (end - self.start).astype(np.uint64) * MIX)


def words(points: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> Words:
    edge = np.diff(blank.astype(np.int8))
    start, end = np.nonzero(edge == -1)[0] + 1, np.nonzero(edge == 1)[0] + 1
    power, inverse = _powers(max(2 * CHUNK, len(points)))
    values = mix(points.astype(np.uint64) + ODD)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(points)])])
    return Words(start, end, np.searchsorted(starts, start, "right") - 1, sums, inverse)


def char_grams(points: np.ndarray, blank: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: n, a 64-bit hash of the n characters from each place on,
    and which of them lie in one word.  The blank before or after a word counts as its
    first or last character for n > 1.  Both arrays have one entry for each code point."""
    values = mix(np.where(blank, np.uint64(32), points.astype(np.uint64)))
    rolled = values.copy()
    inner = np.zeros(len(points), bool)
    for n in range(1, longest + 1):
        if n > 1:
            rolled[: 1 - n] = rolled[: 1 - n] * ODD + values[n - 1 :]
        if n > 2:
            inner[: 2 - n] |= blank[n - 2 :]
        good = ~inner
        if n == 1:
            good &= ~blank
        elif n == 2:
            good[:-1] &= ~(blank[:-1] & blank[1:])
        if n > 1:
            good[1 - n :] = False
        yield n, mix(rolled ^ mix(np.array([n], np.uint64))), good


def per_owner(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of a chunk's values per piece, added up per text."""
    return np.bincount(owner, weights=values, minlength=n)
