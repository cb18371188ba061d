"""Language-model scores by prediction by partial matching over bytes, beside a smoothed unigram base.

The trie of byte contexts is counted over the whole training part of a corpus and stays distributed, every node of it: its
parts meet the distinct grams of slices of texts, and only logarithms return to the texts. Escapes follow method C (an unseen symbol gets
as much weight as there are distinct symbols in the context), and symbols of a context are excluded from the shorter ones.
With fixed counts the symbols of a context are always among those of the next shorter one, so every exclusion is known when
the model is compiled, and a text's code length is a sum of lookups."""

from __future__ import annotations

import io
import math
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import crc_mod, discard, materialize, pack, threshold_for, unpack
from sievework.llm.shingles import Words, parts

#: Bytes of context; with the symbol they must fit a 64-bit number.
ORDER = 5
#: Last bytes of a context that say which part of the trie has it; nodes of shorter contexts are in every part.
SUFFIX = 3
#: Bytes of text that are scored together, and training tokens for each part of the trie; parts grow in number with the input.
SLICE = 3 << 20
PART_TOKENS = 2_000_000
#: Most words whose counts are broadcast; counts of the others are joined by a shuffle.
HEAD_WORDS = 1 << 18
#: Bytes of text that are counted together, and distinct grams that a Python worker holds before it passes them on.
COUNTED = 2 << 20
MOST_HELD = 2_000_000
#: No word holds it: it ends a text, both as a token and as a symbol, and pads the first contexts.
END = b"\n"


def _plain(own: Words) -> list[bytes]:
    """The texts as words parted by one space."""
    lists = pa.LargeListArray.from_arrays(pa.array(own.starts), own.distinct.take(pa.array(own.codes)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts (words parted by one space): contexts and symbols as numbers, and the range of each text among them."""
    pad = END * order
    joined = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    grams = np.zeros(max(0, len(joined) - order), np.uint64)
    for i in range(order + 1):
        grams = (grams << np.uint64(8)) | joined[i : len(joined) - order + i]
    begins = np.concatenate([[0], np.cumsum(lengths + order)])[:-1]
    return grams, begins, lengths


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], np.concatenate([n for _, n in parts])[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            keys, counts = _merged(held)
            for at in range(0, len(keys), 200_000):
                yield pa.record_batch({"gram": pa.array(keys[at : at + 200_000].view(np.int64)), "n": pa.array(counts[at : at + 200_000])})

        for batch in batches:
            for _, _, own in parts(batch.column(0), COUNTED, True):
                grams, begins, lengths = symbols(_plain(own), order)
                inside = np.zeros(len(grams) + 1, np.int8)
                np.add.at(inside, begins, 1)
                np.add.at(inside, np.minimum(begins + lengths, len(grams)), -1)
                keys, counts = np.unique(grams[np.cumsum(inside[:-1]).astype(bool)], return_counts=True)
                held.append((keys, counts.astype(np.int64)))
                if len(held) > 1 and sum(len(k) for k, _ in held) > MOST_HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > MOST_HELD:
                        yield from rows()
                        held = []
            pa.default_memory_pool().release_unused()
        if held:
            yield from rows()

    return run


def gram_tables(docs: DataFrame, order: int, text: str = "text") -> list[DataFrame]:
    """Counts of (context, symbol) of every order, a table each: columns depth, gram, n. Shorter contexts sum up the longer ones."""
    longest = docs.select(text).mapInArrow(_grams(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels = [materialize(longest.select(F.lit(order).alias("depth"), "gram", "n"), "grams")]
    for depth in range(order - 1, -1, -1):
        mask = (1 << 8 * (depth + 1)) - 1
        levels.append(materialize(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n")).select(F.lit(depth).alias("depth"), "gram", "n"), "grams"))
    return levels


class Model:
    """The trie with all logarithms (base 10) that scoring needs. nodes[k]: sorted numbers of order k's contexts with symbols, and counts."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(nodes) - 1
        self.levels = []
        upper: dict = {}
        for depth, (grams, counts) in enumerate(nodes):
            grams = grams.astype(np.uint64)
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(grams) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(grams)))
            level = {"grams": grams, "contexts": contexts, "count": np.log10(counts).astype(np.float32), "total": total, "kinds": kinds, "n": counts}
            level["direct"] = (level["count"] - np.repeat(np.log10(total + kinds), kinds)).astype(np.float32)
            level["escape"] = np.log10(kinds / (total + kinds))
            if depth and len(grams):
                shorter = np.uint64((1 << 8 * depth) - 1)
                under = upper["n"][np.searchsorted(upper["grams"], grams & shorter)]
                at = np.searchsorted(upper["contexts"], contexts & np.uint64((1 << 8 * (depth - 1)) - 1))
                left, rest = upper["total"][at] - np.add.reduceat(under, first), upper["kinds"][at] - kinds
                both = np.maximum(left + rest, 1)
                level["below"] = np.log10(both)
                level["pass"] = np.where(rest > 0, np.log10(np.maximum(rest, 1) / both), 0.0)
            self.levels.append(level)
            upper = level
        seen = int(self.levels[0]["kinds"].sum()) if self.levels and len(self.levels[0]["grams"]) else 0
        self.unseen = -math.log10(256 - seen) if seen < 256 else 0.0
        for level in self.levels:
            for name in ("total", "kinds", "n"):
                level.pop(name)

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's symbol after its context; quickest over sorted grams."""
        top = self.levels[self.order]
        at, hit = self._find(top["grams"], grams)
        out = np.where(hit, top["direct"][at], 0.0) if len(top["grams"]) else np.zeros(len(grams))
        todo = np.flatnonzero(~hit)
        begun = np.zeros(len(todo), bool)
        longer = np.zeros(len(todo), np.int64)
        for depth in range(self.order, -1, -1):
            if not len(todo):
                break
            level = self.levels[depth]
            own = grams[todo] & np.uint64((1 << 8 * (depth + 1)) - 1)
            at, hit = self._find(level["grams"], own)
            context, there = self._find(level["contexts"], own >> np.uint64(8))
            fresh = ~begun & there
            out[todo[fresh & hit]] += level["direct"][at[fresh & hit]]
            out[todo[fresh & ~hit]] += level["escape"][context[fresh & ~hit]]
            if begun.any():
                above = self.levels[depth + 1]
                a, b = begun & hit, begun & ~hit
                out[todo[a]] += level["count"][at[a]] - above["below"][longer[a]]
                out[todo[b]] += above["pass"][longer[b]]
            left = ~hit | ~(begun | fresh)
            todo, begun, longer = todo[left], (begun | fresh)[left], context[left]
        if len(todo):
            out[todo] += np.where(begun, self.unseen, -math.log10(256))
        return out

    def texts(self, texts: list[bytes]) -> list[float]:
        """The log10 probability of each text: its words parted by one space, and an end."""
        grams, begins, lengths = symbols(texts, self.order)
        if not texts:
            return []
        distinct, inverse = np.unique(grams, return_inverse=True)
        each = np.append(self.log10(distinct)[inverse], 0.0)
        return np.add.reduceat(each, np.column_stack([begins, begins + lengths]).ravel())[::2].tolist()


def _part(grams, parts: int):
    """The part of the trie that scores grams, by the last bytes of their contexts; of numpy numbers or of a Column."""
    if isinstance(grams, np.ndarray):
        context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * SUFFIX) - 1)
        return ((context * np.uint64(2654435761) >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(parts)
    context = F.shiftright(grams, 8).bitwiseAND(F.lit((1 << 8 * SUFFIX) - 1))
    return F.shiftright(context * F.lit(2654435761), 8).bitwiseAND(F.lit(0xFFFFFF)) % F.lit(parts)


def _levels(depth: np.ndarray, gram: np.ndarray, n: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for k in orders:
        keys, counts = gram[depth == k].view(np.uint64), n[depth == k]
        by = np.argsort(keys)
        out.append((keys[by], counts[by]))
    return out


def _by_part(texts: list[bytes], order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of texts by part and number, the part of each, each gram's place among them, and the range of each text."""
    grams, begins, lengths = symbols(texts, order)
    encoded = pa.array(grams).dictionary_encode()
    distinct, inverse = encoded.dictionary.to_numpy(), encoded.indices.to_numpy()
    part = _part(distinct, parts)
    by = np.lexsort((distinct, part))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return distinct[by], part[by].astype(np.int64), place[inverse], begins, lengths


def logs(nodes: DataFrame, asked: DataFrame, order: int, parts: int) -> DataFrame:
    """(slice, part, size, logs) of asked (slice, part, size, data): the model's log10 of each gram, in the order of data.

    nodes (depth, gram, n) are the whole trie. A task holds a part of it and the nodes of the shortest contexts, whose
    number bytes bound; exclusions and escapes of a gram need nothing else, as all its contexts end alike."""
    short = nodes.where(F.col("depth") < SUFFIX).toArrow()
    base = _levels(*(short.column(c).to_numpy() for c in ("depth", "gram", "n")), range(min(SUFFIX, order + 1)))
    shared = nodes.sparkSession.sparkContext.broadcast(base)

    def answer(own: pa.Table, asks: pa.Table) -> pa.Table:
        columns = (own.column(c).to_numpy() for c in ("depth", "gram", "n")) if own.num_rows else (np.zeros(0, np.int64),) * 3
        model = Model([*shared.value, *_levels(*columns, range(len(shared.value), order + 1))])
        found = []
        for data, n in zip(asks.column("data").to_pylist(), asks.column("size").to_pylist(), strict=True):
            found.append(pack(model.log10(np.cumsum(unpack(data, n, "<u8"), dtype=np.uint64)).astype("<f4")))
        return pa.table({"slice": asks.column("slice"), "part": asks.column("part"), "size": asks.column("size"), "logs": pa.array(found, pa.binary())})

    deep = nodes.where(F.col("depth") >= SUFFIX).select(_part(F.col("gram"), parts).alias("part"), "depth", "gram", "n")
    return deep.groupBy("part").cogroup(asked.select("slice", "part", "size", "data").groupBy("part")).applyInArrow(answer, "slice long, part long, size long, logs binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, own in parts(batch.column(0), SLICE, True):
            counts = np.bincount(own.codes, minlength=len(own.distinct))
            real = np.flatnonzero(counts)
            yield pa.record_batch({"word": own.distinct.take(pa.array(real)).cast(pa.binary()), "n": pa.array(counts[real])})


def score(docs: DataFrame, order: int = ORDER, head_words: int = HEAD_WORDS, held: tuple[int, int] = (7, 2)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all docs (doc_id, text).

    held_out: crc32 of the id as text, modulo held[0], is held[1]; held-out texts are not learned from, and a null id is
    never held out. Null and empty texts are one end. Texts are scored whole, with A-Z lower-cased and white space as one
    space. Repeated rows and ids give a row each. Without training texts every symbol has probability 1/256."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    texts = train.count()
    words = train.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(words, "counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # every training text has one end, a token that no word equals
    tokens, kinds = int(sums["n"] or 0) + texts, int(sums["v"]) + (texts > 0)
    end = math.log10(texts + 1) if texts else None
    least = threshold_for(counts, "n", head_words)
    top = counts.where(F.col("n") >= least).toArrow().combine_chunks()
    head = spark.sparkContext.broadcast((pa.array(top.column("word").to_pylist(), pa.large_binary()), np.log10(top.column("n").to_numpy() + 1)))
    levels = gram_tables(train, order)
    nodes = reduce(DataFrame.unionByName, levels)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // PART_TOKENS)

    def known(own: Words) -> np.ndarray:
        """The number in the head of each distinct word, or -1."""
        return pc.index_in(own.distinct.cast(pa.large_binary()), value_set=head.value[0]).fill_null(-1).to_numpy()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in parts(batch.column(2), SLICE, True):
                out = (known(own) < 0)[own.codes]
                both, times = np.unique(own.rows[out] * len(own.distinct) + own.codes[out], return_counts=True)
                row, code = pa.array(both // max(1, len(own.distinct))), pa.array(both % max(1, len(own.distinct)))
                ids, marks = (batch.column(i).slice(a, b - a).take(row) for i in (0, 1))
                yield pa.record_batch([ids, marks, own.distinct.take(code).cast(pa.binary()), pa.array(times, pa.int64())], names=["doc_id", "mark", "word", "times"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of texts: a row for each part of the trie that a slice asks, and one without a part that holds the texts."""
        for batch in batches:
            for a, b, words in parts(batch.column("text"), SLICE, True):
                at, rows = known(words)[words.codes], words.rows
                fine = at >= 0
                n_known = np.bincount(rows[fine], minlength=b - a) + (end is not None)
                base = np.bincount(rows[fine], head.value[1][at[fine]], b - a) + (end or 0.0)
                plain = _plain(words)
                columns = {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out", "mark")}
                columns |= {"n_tokens": pa.array(np.diff(words.starts) + 1), "head_known": pa.array(n_known.astype(np.int64)), "head_sum": pa.array(base), "text": pa.array(plain, pa.large_binary())}
                whole = pa.record_batch(columns)
                own = int.from_bytes(os.urandom(8), "little") >> 1
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(whole)
                grams, part, _, _, _ = _by_part(plain, order, n_parts)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(first, len(part))[1:]
                data = [pack(np.diff(grams[x:y], prepend=np.uint64(0))) for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"slice": pa.array([own] * (len(first) + 1), pa.int64()), "part": pa.array([None, *part[first].tolist()], pa.int64()), "size": pa.array([b - a, *(ends - first).tolist()], pa.int64()), "data": pa.array([sink.getvalue(), *data], pa.binary())})
            pa.default_memory_pool().release_unused()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, answers in zip(batch.column("data"), batch.column("answers"), strict=True):
                (rows,) = pa.ipc.open_stream(data.as_buffer()).read_all().to_batches()
                _, _, place, begins, lengths = _by_part(rows.column("text").to_pylist(), order, n_parts)
                found = sorted(answers.as_py(), key=lambda x: x["part"])
                each = np.concatenate([unpack(x["logs"], x["size"], "<f4") for x in found]).astype(np.float64)
                each = np.append(each[place], 0.0)
                own = np.add.reduceat(each, np.column_stack([begins, begins + lengths]).ravel())[::2]
                yield pa.record_batch([*rows.columns[:-1], pa.array(own, pa.float64())], names=[*rows.schema.names[:-1], "score"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text", "held_out")
    tail = marked.select("doc_id", "mark", "text").mapInArrow(rare, "doc_id long, mark long, word binary, times long").join(counts.where(F.col("n") < least), "word")
    tail = tail.select("doc_id", "mark", F.lit(0).alias("same"), "times", (F.col("times") * F.log10(F.col("n") + 1)).alias("part"))
    pieces = materialize(marked.mapInArrow(cut, "slice long, part long, size long, data binary"), "slices")
    answers = logs(nodes, pieces.where(F.col("part").isNotNull()), order, n_parts).groupBy("slice").agg(F.collect_list(F.struct("part", "size", "logs")).alias("answers"))
    bodies = pieces.where(F.col("part").isNull()).select("slice", "data").join(answers, "slice")
    heads = bodies.select("data", "answers").mapInArrow(scored, "doc_id long, held_out boolean, mark long, n_tokens long, head_known long, head_sum double, score double")
    heads = materialize(heads, "scores")
    discard(pieces, *levels)
    by_doc = heads.select("doc_id", "mark", F.lit(1).alias("same"), F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("part")).unionByName(tail)
    by_doc = by_doc.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sum("same").alias("same"), F.sum("times").alias("times"), F.sum("part").alias("part"))
    joined = heads.join(by_doc, heads["doc_id"].eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + (F.col("times") / F.col("same")).cast("long")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("part") / F.col("same") - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))).alias("base_score"),
        "score",
    )
