"""Hashes of words and of windows of words, for many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes whose words are held together.
CHUNK_BYTES = 1 << 20
#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256
#: Words that a dictionary of keyed digests remembers, and bytes of the longest such word.
REMEMBERED, SHORT_WORD = 500_000, 64

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LEFT = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order. The scrambling after each step leaves no sum or product for texts to agree in."""
    return mix(left * _LEFT + right)


class Windows:
    """Hashes of windows of consecutive words: those of 1, 2, 4, .. words of two halves, others of a few of these."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def __call__(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of each ``size`` words, or of those that start at the places ``at``."""
        while 2 << len(self.levels) - 1 <= size:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(joined(last[: max(0, len(last) - half)], last[half:]))
        n, out, reach = max(0, len(self.levels[0]) - size + 1), None, 0
        for level, part in enumerate(self.levels):
            if size >> level & 1:
                next_part = part[reach : reach + n] if at is None else part[at + reach]
                out = next_part if out is None else joined(out, next_part)
                reach += 1 << level
        return out


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop; they end at ASCII white space, as does ``data``."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each word, eight bytes after eight with scrambling between; ``data`` goes on for 8 bytes after the last word."""
    lanes = np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))
    lengths = stops - starts
    out = mix(lengths.astype(np.uint64) + np.uint64(seed))
    left, where, at = np.minimum(lengths, LONG_WORD), np.arange(len(starts)), starts
    while len(where):
        kept = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        out[where] = joined(out[where], lanes[at] & kept)
        more = left > 8
        left, where, at = left[more] - 8, where[more], at[more] + 8
    for k in np.flatnonzero(lengths > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : stops[k]].tobytes(), seed)
    return out


class WordKeys(dict):
    """64-bit digests of words under a secret key: who writes texts can't know which words or shingles would agree."""

    def __init__(self, key: bytes):
        self.key = key

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= SHORT_WORD:
            self[word] = value
        return value


def digests(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of byte strings, as two halves."""
    halves = np.frombuffer(b"".join([blake2b(piece, digest_size=16).digest() for piece in pieces]), dtype="<u8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


class Chunk(NamedTuple):
    """Some neighbouring rows of a batch. Row i's words are ``words[at[i]:at[i + 1]]``; word k is ``data[starts[k]:stops[k]]``."""

    first: int
    at: np.ndarray
    words: np.ndarray
    data: bytes
    starts: np.ndarray
    stops: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1

    def spelled(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        """The words from ``first`` to ``last``, as they are written, with what is between them."""
        return (self.data[a:b] for a, b in zip(self.starts[first].tolist(), self.stops[last].tolist(), strict=True))


def parts(body: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK_BYTES that end between words."""
    at = 0
    while at < len(body):
        end = _SPACE.search(body, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(body) else None
        stop = end.start() if end else len(body)
        yield body[at:stop]
        at = stop


def chunks(texts: pa.Array, *, spaced: bool = False, keys: WordKeys | None = None) -> Iterator[Chunk]:
    """The texts of a batch, hashed chunk by chunk; null is empty. ``spaced`` puts one space between words; ``keys`` hashes words."""

    def hashed(first: int, bodies: list[bytes]) -> Chunk:
        whole = b"\n".join(bodies) if len(bodies) > 1 else bodies[0]
        pieces = [whole] if len(bodies) > 1 else parts(whole)
        words, starts, stops, before = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], 0
        for piece in pieces:
            data = np.frombuffer(piece + b" " * 9, dtype=np.uint8)
            edges = word_edges(data)
            words.append(np.fromiter(map(keys.__getitem__, piece.split()), dtype=np.uint64, count=len(edges[0])) if keys is not None else word_hashes(data, *edges))
            starts.append(edges[0] + before)
            stops.append(edges[1] + before)
            before += len(piece)
        ends = np.cumsum([len(b) + 1 for b in bodies])
        begin = np.concatenate(starts)
        at = np.searchsorted(begin, ends)
        return Chunk(first, np.concatenate([[0], at]).astype(np.int64), np.concatenate(words), whole, begin, np.concatenate(stops))

    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        body = (text.as_py() or "").encode()
        if spaced:
            body = b" ".join(body.split())
        if held and size + len(body) > CHUNK_BYTES:
            yield hashed(first, held)
            held, size, first = [], 0, i
        held.append(body)
        size += len(body) + 1
    if held:
        yield hashed(first, held)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for counts[0] values, then the same for the next."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))
