"""Words and shingles of whole Arrow batches: each distinct word of a part is one object, texts are arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from sievework.llm.common import slices

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: the distinct ones, which of them stands at each place, and where each text's places begin."""

    distinct: pa.Array
    codes: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The text of each place."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def words(texts: pa.Array) -> Words:
    """Words are runs without ASCII white space, compared byte by byte; null counts as empty."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    blank = pc.index(encoded.dictionary, "").as_py()
    if blank >= 0:  # white space at an end of a text leaves an empty piece there
        real = codes != blank
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        codes = codes[real]
    return Words(encoded.dictionary, codes, starts)


def parts(texts: pa.Array, most_bytes: int, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Slices (first row, row after the last, words) of an Arrow string column, of about most_bytes of text each.

    With fold A-Z are lower-cased."""
    if len(texts):
        texts = texts.cast(pa.large_string()).fill_null("")
        for a, b in slices(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], most_bytes):
            own = texts.slice(a, b - a)
            yield a, b, words(pc.ascii_lower(own) if fold else own)


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def shingle_sets(column: pa.Array, k: int, most_bytes: int = 2 << 20) -> Iterator[np.ndarray]:
    """For each text of an Arrow string column, in order: its sorted distinct k-word shingles as 64-bit numbers, A-Z lower-cased.

    A text of fewer words is one shingle, without words it has none; null counts as empty."""
    for _, _, own in parts(column, most_bytes, True):
        hashed = hashes(own.distinct)[own.codes] if len(own.distinct) else np.zeros(0, np.uint64)
        n = max(0, len(hashed) - k + 1)
        grams = np.full(n, np.uint64(k))
        for i in range(k):
            grams = mix(grams * _BASE ^ hashed[i : n + i])
        for x, y in zip(own.starts[:-1].tolist(), own.starts[1:].tolist(), strict=True):
            if y - x >= k:
                yield np.unique(grams[x : y - k + 1])
            elif y > x:
                short = np.full(1, np.uint64(y - x))
                for i in range(x, y):
                    short = mix(short * _BASE ^ hashed[i : i + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)
