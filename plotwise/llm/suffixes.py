"""The lexicographic order of all suffixes of many strings, by prefix-free parsing."""

from __future__ import annotations

import numpy as np


def suffix_ranks(symbols: np.ndarray, last: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The rank of the string that runs from each place to its ``last`` place, both included; equal strings share one.

    Prefix doubling over symbols from 1 up; a string that ends earlier comes first. A rank is the number of strings
    that come before. Each round sorts only strings that share a rank and go on; it ends when none is left, or when
    ``depth`` symbols have been compared, so strings that share those may share a rank.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    used = np.zeros(int(symbols.max()) + 1, np.int64)
    used[symbols] = 1
    symbols = np.cumsum(used)[symbols]
    places, wide = np.arange(n), int(symbols.max()).bit_length()
    span, left = max(1, 62 // wide), last - places

    def longer(key: np.ndarray, size: int, tail: np.ndarray, more: int) -> np.ndarray:
        """Keys of ``size`` symbols with the ``more`` that follow; none follow a string's last."""
        key = key << (wide * more)
        if size < n:
            key[:-size] |= np.where(left[:-size] >= size, tail[size:], 0)
        return key

    key, size = symbols, 1
    for bit in f"{span:b}"[1:]:
        key, size = longer(key, size, key, size), 2 * size
        if bit == "1":
            key, size = longer(key, size, symbols, 1), size + 1
    work, rank = places, np.zeros(n, np.int64)
    while len(work):
        order = np.argsort(key)
        ordered, held = key[order], work[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(held)))
        # A class keeps its rank, moved on by those of its old class that now come before.
        old = rank[held]
        old_begin = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), np.arange(len(held)), 0))
        rank[held] = old + np.repeat(begin, size) - old_begin
        if depth is not None and span >= depth:
            break
        work = held[np.repeat(size > 1, size)]
        work = work[work + span <= last[work]]
        key = rank[work] * (n + 1) + rank[work + span] + 1
        span *= 2
    return rank


class PrefixFreeParse:
    """Phrases, dictionary and parse of strings laid end to end, and from both the order of their suffixes.

    Bytes become symbols from 2 up, and ``width`` ones stand around every string. A window of ``width`` symbols is a
    trigger if its rolling hash leaves 0 over ``modulus``, or if it is all ones. A phrase runs from one trigger to the
    end of the next, so no suffix of a phrase that is longer than ``width`` is the beginning of another one's. The
    dictionary is the distinct phrases, told apart by their symbols and sorted; the parse is their numbers in the order
    of the text. The order of a suffix of the text is that of its phrase's suffix in the dictionary, and among equal
    ones that of the parse from the next phrase on. With ``depth``, the order is that of the first ``depth`` bytes at
    least, which spares long runs; else it is whole.
    """

    def __init__(self, strings: list[bytes], width: int = 4, modulus: int = 24, depth: int | None = None):
        self.width, self.depth = width, depth
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = width + np.concatenate(([0], np.cumsum(lengths + width)[:-1])) if len(strings) else np.zeros(0, np.int64)
        self.lengths = lengths
        gap = b"\x00" * width
        self.raw = gap + gap.join(strings) + gap
        symbols = np.frombuffer(self.raw, np.uint8).astype(np.int64) + 2
        step = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(step, self.starts, 1)
        np.add.at(step, self.starts + lengths, -1)
        symbols[np.cumsum(step[:-1]) == 0] = 1
        self.symbols = symbols
        self._phrases(modulus)
        self._dictionary()

    def _phrases(self, modulus: int) -> None:
        n, w = len(self.symbols), self.width
        rolled, ones = np.zeros(n - w + 1, np.uint64), np.ones(n - w + 1, bool)
        for t in range(w):
            own = self.symbols[t : n - w + 1 + t]
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + own.astype(np.uint64)
            ones &= own == 1
        rolled ^= rolled >> np.uint64(31)
        left = ((rolled * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(modulus)
        self.at = np.flatnonzero(ones | (left == 0))

    def _dictionary(self) -> None:
        raw = self.symbols.astype(">u2").tobytes()
        begins, ends = self.at[:-1], self.at[1:] + self.width
        numbers: dict[bytes, int] = {}
        parse = np.array([numbers.setdefault(raw[2 * a : 2 * z], len(numbers)) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64)
        phrases = sorted(numbers)
        place = np.empty(len(phrases), np.int64)
        for rank, phrase in enumerate(phrases):
            place[numbers[phrase]] = rank
        self.parse = place[parse] if len(parse) else parse
        sizes = np.array([len(p) // 2 for p in phrases], np.int64)
        self.phrase_starts = np.concatenate(([0], np.cumsum(sizes)))
        self.dictionary = np.frombuffer(b"".join(phrases), ">u2").astype(np.int64)
        self.dictionary_ranks = suffix_ranks(self.dictionary, np.repeat(self.phrase_starts[1:] - 1, sizes), self.depth)
        self.parse_ranks = np.append(suffix_ranks(self.parse, np.full(len(self.parse), len(self.parse) - 1), self.depth) + 1, 0)

    def order(self, places: np.ndarray) -> np.ndarray:
        """The given places of the buffer in the lexicographic order of the suffixes that start there."""
        phrase = np.searchsorted(self.at, places, side="right") - 1
        own = self.dictionary_ranks[self.phrase_starts[self.parse[phrase]] + places - self.at[phrase]]
        return places[np.argsort(own * (len(self.parse) + 2) + self.parse_ranks[phrase + 1], kind="stable")]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, place in it, class) of every window of ``length`` bytes: windows with the same bytes share a class.

        Equal windows stand together in the order of the suffixes; neighbours are compared byte by byte.
        """
        if self.depth is not None and length > self.depth:
            raise ValueError("the order does not reach the length of the windows")
        count = np.maximum(self.lengths - length + 1, 0)
        string = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(string)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count, count)
        if not len(string):
            return string, inner, string
        places = self.starts[string] + inner
        ordered = self.order(places)
        same = np.ones(len(ordered) - 1, bool)
        step = min(8, length)
        eight = np.ndarray((len(self.raw) - step + 1,), f"<u{step}" if step in (1, 2, 4, 8) else f"V{step}", self.raw, 0, (1,))
        for t in [*range(0, length - step, step), length - step]:
            part = eight[ordered + t]
            same &= part[1:] == part[:-1]
        number = np.empty(len(self.raw), np.int64)
        number[ordered] = np.concatenate(([0], np.cumsum(~same)))
        return string, inner, number[places]
