"""Toxicity by cumulative-link ordinal regression over the words of a text.

One weight for each word is shared by all thresholds: P(grade >= j) = 1 / (1 + exp(threshold_j - weights of the words))."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import discard, materialize
from sievework.llm.shingles import parts

#: About so many labelled rows are fitted, drawn by a hash of doc_id; all of them if there are fewer.
TRAIN_ROWS = 12_000
#: Grades of severity: 0 fine, 1 of low quality, 2 toxic.
GRADES = 3
TOXIC = 2
#: A word is a feature if its likelihood ratio over the grades is one that chance would give any of all words this often.
CHANCE = 0.05
PENALTY = 1e-4
STEPS = 400
#: A text is rejected if it is more likely toxic than not.
REJECT = 0.5
#: Bytes of text that are looked at together.
PART = 4 << 20
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def _stems(distinct: pa.Array) -> pa.Array:
    """Words without punctuation at their edges, A-Z lower-cased; empty if nothing else is there."""
    return pc.utf8_trim(pc.ascii_lower(distinct), characters=_EDGES)


def _held(own, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text and number of a stem once: which stems (null is none) the texts hold."""
    number = stems.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[own.codes]
    rows = own.rows[number >= 0]
    both = np.unique(np.column_stack([rows, number[number >= 0]]), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each margin."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin[:, None], -500, 500)))


def solve(flat: np.ndarray, row: np.ndarray, grades: np.ndarray, n_words: int, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows at once; row holds feature flat.

    Thresholds are the first one and positive gaps, so they stay in order."""
    rows = grades
    gaps = GRADES - 1
    x = np.concatenate([np.zeros(n_words), [1.0], np.zeros(gaps - 1)])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        weights, cut = x[:n_words], np.cumsum(np.concatenate([x[n_words : n_words + 1], np.exp(x[n_words + 1 :])]))
        margin = np.bincount(row, weights[flat], len(rows))
        over = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(cut - margin[:, None], -500, 500))), np.zeros((len(rows), 1))], 1)
        at = np.arange(len(rows))
        chance = np.maximum(over[at, grades] - over[at, grades + 1], 1e-12)
        slope = over * (1 - over)
        by_cut = np.zeros((len(rows), gaps))
        for j in range(gaps):
            by_cut[:, j] = (np.where(grades == j + 1, -slope[:, j + 1], 0) + np.where(grades == j, slope[:, j + 1], 0)) / chance
        d_margin = -by_cut.sum(1)
        d_cut = by_cut.sum(0)
        d_x = np.concatenate([np.bincount(flat, d_margin[row], n_words) / len(rows) - penalty * weights, [d_cut.sum() / len(rows)], [d_cut[j:].sum() * np.exp(x[n_words + j]) / len(rows) for j in range(1, gaps)]])
        first, second = 0.9 * first + 0.1 * d_x, 0.999 * second + 0.001 * d_x**2
        x = x + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:n_words], np.cumsum(np.concatenate([x[n_words : n_words + 1], np.exp(x[n_words + 1 :])]))


def ratio(held: list[Column], totals: list[int]) -> Column:
    """Twice the log likelihood ratio of a word's counts in the grades against one share in all of them."""
    n, all_ = sum(held, F.lit(0)), sum(totals)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    return 2 * sum((part(h, n * t / all_) + part(t - h, (all_ - n) * t / all_) for h, t in zip(held, totals, strict=True) if t), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, chance: float = CHANCE) -> Model:
    """The model of docs (doc_id, text) with labels (doc_id, toxic, quality); rows without a toxic label or an id are left out.

    If a document has several labels, the most severe counts; a null quality is no low one. Of equal rows one is fitted. Of all words of the drawn rows
    those are features whose counts in the grades differ by more than chance: the others would drown them in long texts.
    Without labels the model has no words and rejects nothing."""
    grade = F.when(F.col("toxic") != 0, TOXIC).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(0)
    graded = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    n = graded.count()
    nothing = Model([], np.zeros(0), np.full(GRADES - 1, np.inf))
    if not n:
        return nothing
    drawn = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, train_rows / n) * 1_000_000)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in parts(batch.column(1), PART):
                encoded = _stems(own.distinct).dictionary_encode()
                rows, stems = _held(own, encoded.indices)
                starts = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(starts), encoded.dictionary.take(pa.array(stems)).cast(pa.string()))], names=["grade", "words"])

    # the drawn labels are bounded by train_rows
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = materialize(rows.select("grade", "text").mapInArrow(distinct, "grade int, words array<string>"), "graded")
    sums = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [sums.get(g, 0) for g in range(GRADES)]
    if not sum(totals):
        discard(rows)
        return nothing
    each = [F.count(F.when(F.col("grade") == g, 1)).alias(f"g{g}") for g in range(GRADES)]
    held = rows.select("grade", F.explode("words").alias("word")).where(F.col("word") != "").groupBy("word").agg(*each)
    held = materialize(held, "words")
    kinds = held.count()
    words = sorted(r["word"] for r in held.where(ratio([F.col(f"g{g}") for g in range(GRADES)], totals) > 2 * np.log(max(1, kinds) / chance).item()).select("word").collect())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            flat = pc.index_in(batch.column(1).flatten(), value_set=known)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            real = flat.is_valid().to_numpy(zero_copy_only=False)
            starts = np.searchsorted(text[real], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(starts), flat.drop_null())], names=["grade", "own"])

    found = rows.mapInArrow(coded, "grade int, own array<int>").toArrow().combine_chunks()
    discard(rows, held)
    lists = found.column("own").combine_chunks()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    weights, thresholds = solve(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), row, found.column("grade").to_numpy().astype(np.int64), len(words))
    return Model(words, weights, thresholds)


def _margins(model: Model, texts: pa.Array) -> np.ndarray:
    """The sum of the weights of each text's words; every word counts once."""
    out = np.zeros(len(texts))
    known = pa.array(model.words, pa.large_string())
    for a, b, own in parts(texts, PART):
        rows, features = _held(own, pc.index_in(_stems(own.distinct), value_set=known))
        out[a:b] = np.bincount(rows, model.weights[features], b - a)
    return out


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id of docs with p_toxic, severity (the expected grade), grade (the likeliest, the lower on ties) and rejected.

    Every word of the whole text counts once. Null and empty texts hold no words and are judged by the thresholds alone,
    like a text of unknown words. Rows stand by themselves; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = model.at_least(_margins(model, batch.column("text")))
            exact = -np.diff(over, axis=1, prepend=1.0, append=0.0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(over[:, TOXIC - 1]), pa.array(over.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(over[:, TOXIC - 1] >= REJECT)], names=["doc_id", "p_toxic", "severity", "grade", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_toxic double, severity double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that `judge` rejects, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = model.at_least(_margins(model, batch.column(at)))
            yield batch.filter(pa.array(over[:, TOXIC - 1] < REJECT))

    return docs.mapInArrow(run, docs.schema)
