"""Language identification, word first: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shingles import hashes, mix, parts

#: The model learns from about so many different texts of each language, drawn by a hash of the text, whatever the corpus holds.
TRAIN_TEXTS = 1000
LONGEST_GRAM = 5
SMOOTHING = 0.5
#: Bytes of text that are looked at together.
PART = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters (Unicode category L) of lower-cased words one after the other, and where each word's begin."""
    lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(distinct), r"\P{L}+", " ")))
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[starts - starts[0]]


def grams(words: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the character n-grams of words with a mark before and after each, and the word of each key."""
    own = [f"\x02{w}\x03" for w in words.to_pylist()]
    points = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    word = np.repeat(np.arange(len(own)), lengths)
    n = max(0, len(points) - size + 1)
    inside = word[:n] == word[size - 1 : size - 1 + n]
    keys = np.full(n, np.uint64(size))
    for i in range(size):
        keys = mix(keys * _BASE ^ points[i : n + i])
    return keys[inside], word[:n][inside]


def _logs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the log frequency of each by language."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    table = np.column_stack([np.bincount(inverse, counts[:, i], len(distinct)) for i in range(counts.shape[1])])
    return distinct, np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * max(1, len(distinct)))).astype(np.float32)


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in a table, and whether they are there."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return at, table[0][at] == keys


@dataclass
class Model:
    """Log frequencies by language of words (levels[0]) and of n-grams of each size, by the hash of either."""

    langs: list[str]
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, langs: pa.Array, words: pa.Array, n: np.ndarray) -> Model:
        """From counts n of (lang, word), each pair once."""
        names = sorted(set(langs.to_pylist()))
        encoded = words.dictionary_encode()
        counts = np.zeros((len(encoded.dictionary), len(names)))
        counts[encoded.indices.to_numpy(), pc.index_in(langs, value_set=pa.array(names, langs.type)).to_numpy()] = n
        levels = [_logs(hashes(encoded.dictionary), counts)]
        for size in range(1, LONGEST_GRAM + 1):
            keys, word = grams(encoded.dictionary, size)
            levels.append(_logs(keys, counts[word]))
        return cls(names, levels)

    def words(self, words: pa.Array) -> np.ndarray:
        """Log scores of words: their own, or those of their longest n-grams of which one is known."""
        out = np.zeros((len(words), len(self.langs)))
        at, known = _find(self.levels[0], hashes(words))
        out[known] = self.levels[0][1][at[known]]
        left = np.flatnonzero(~known)
        for size in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            keys, word = grams(words.take(pa.array(left)), size)
            at, known = _find(self.levels[size], keys)
            word, rows = word[known], self.levels[size][1][at[known]]
            for i in range(len(self.langs)):
                out[left, i] += np.bincount(word, rows[:, i], len(left)) / size
            left = left[np.bincount(word, minlength=len(left)) == 0]
        return out


def fit(labelled: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """The model of labelled (text, lang): about train_texts different texts of each language; rows with a null are left out.

    Copies of a text count once, so no group of them makes up the sample. The driver holds a row for each language."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    share = sizes.select(F.col("lang").alias("_lang"), (F.lit(train_texts) / F.col("n") * 1_000_000).alias("_share"))
    drawn = labelled.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("_share"))
    drawn = drawn.select("lang", "text").dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in parts(batch.column(1), PART):
                flat, starts = letters(own.distinct)
                langs = batch.column(0).slice(a, b - a).dictionary_encode()
                lang = langs.indices.to_numpy()[own.rows]
                lengths = np.diff(starts)[own.codes]
                at = np.repeat(starts[own.codes] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(lengths) else np.zeros(0, np.int64)
                encoded = flat.dictionary_encode()
                word = encoded.indices.to_numpy()[at].astype(np.int64)
                both, n = np.unique(np.repeat(lang, lengths).astype(np.int64) * len(encoded.dictionary) + word, return_counts=True)
                if len(both):
                    of = langs.dictionary.take(pa.array(both // len(encoded.dictionary)))
                    yield pa.record_batch([of.cast(pa.string()), encoded.dictionary.take(pa.array(both % len(encoded.dictionary))).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    rows = drawn.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    if not rows.num_rows:
        return Model([], [])
    lang, word, n = (rows.column(c).combine_chunks() for c in ("lang", "word", "n"))
    return Model.fit(lang, word, n.to_numpy())


def _guess(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its share of the likelihoods."""
    names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
    for a, b, own in parts(texts, PART):
        flat, starts = letters(own.distinct)
        if not len(flat) or not model.langs:
            continue
        encoded = flat.dictionary_encode()
        by_word = model.words(encoded.dictionary)[encoded.indices.to_numpy()]
        chunk = np.repeat(np.arange(len(own.distinct)), np.diff(starts))
        rows, some = own.rows, np.diff(starts)[own.codes] > 0
        total = np.column_stack([np.bincount(rows, np.bincount(chunk, by_word[:, i], len(own.distinct))[own.codes], b - a) for i in range(len(model.langs))])
        best = total.argmax(1)
        share = 1 / np.exp(np.maximum(total - total[np.arange(b - a), best][:, None], -700)).sum(1)
        read = np.flatnonzero(np.bincount(rows, some, b - a) > 0)
        names[a + read] = np.array(model.langs, object)[best[read]]
        scores[a + read] = share[read]
    return names.tolist(), scores


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with lang_pred and score, from the column text alone.

    lang_pred has the largest sum of log scores over the whole text, the first in order of name on ties; score is its
    share of the likelihoods, 0 to 1. A text without a letter, null and empty ones among them, is `und` with score 0, as
    is any text if nothing was learned. Repeated rows get equal predictions; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(keep))]
    docs = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("_text"))
    schema = ", ".join([*(f"{n} {t}" for n, t in docs.dtypes[:-1]), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _guess(sent.value, batch.column("_text"))
            yield pa.record_batch([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))
