"""Byte-pair encoding and decoding through a table of distinct words.

Slices of texts are split into words; a slice keeps, for each place in each text, the number of its distinct word. The
distinct words of all slices meet in a table parted by word, where each is encoded once. Their ids return to the slices and
are joined with the places; texts come back from a join of ids with the vocabulary's pieces. Only distinct words and
numbers are shuffled, never texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import discard, materialize, pack, slices, unpack
from sievework.llm.shingles import Words, hashes, parts

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE = 8 << 20
#: Most distinct words whose ids a Python worker keeps; beyond, it forgets them and encodes words again.
KEEP = 600_000
#: Bytes of text that are put together again at once.
PART = 2 << 20
#: Punctuation that a tokenizer parts from a letter or digit before it.
TRAILING = b".,;:!?#$%&*"
#: Marks the start of a special token, which is found before case is folded.
SPECIAL = b"<|"


def words(chunk: bytes) -> tuple[bytes, ...]:
    """The words of a run without ASCII white space; encoding them one by one gives what encoding the run gives.

    Case is folded only up to U+00FF, where it can't meet combining marks, and final punctuation is parted only from a
    letter or digit; any other run stays whole."""
    if SPECIAL in chunk:
        return (chunk,)
    if chunk.isascii():
        chunk = chunk.lower()
        core = chunk.rstrip(TRAILING)
        split = core[-1:].isalnum()
    else:
        text = chunk.decode("utf-8", "replace")
        if max(text) > "\xff":
            return (chunk,)
        chunk = text.lower().encode()
        core = chunk.rstrip(TRAILING)
        last = core[-2:].decode("utf-8", "replace")[-1:]
        split = core[-1:].isalnum() or "\xc0" <= last <= "\xff" and last not in "\xd7\xf7"
    return (core, chunk[len(core) :]) if split and len(core) < len(chunk) else (chunk,)


class Encoder:
    """Ids (little-endian 32-bit numbers) of runs without white space; each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk; runs of odd white space alone have none."""
        if len(self.chunks) > KEEP:
            self.words.clear()
            self.chunks.clear()
        own = {c: words(c) for c in chunks if c not in self.chunks}
        new = list({w for ws in own.values() for w in ws if w not in self.words})
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        self.words.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(new, found, strict=True))
        self.chunks.update((c, b"".join(map(self.words.__getitem__, ws))) for c, ws in own.items())
        return list(map(self.chunks.__getitem__, chunks))


def _buckets(distinct: pa.Array, n: int) -> np.ndarray:
    """The part of the word table that has each run: words that differ in case or final punctuation share theirs."""
    core = pc.utf8_rtrim(pc.utf8_lower(distinct), characters=TRAILING.decode())
    core = pc.if_else(pc.equal(pc.binary_length(core), 0), distinct, core)
    return (hashes(core) % np.uint64(n)).astype("<u4")


def _key(rows: pa.RecordBatch) -> int:
    """A number that names a slice by all that it holds."""
    digest = xxhash.xxh3_64()
    for column in rows.columns:
        for buffer in pa.concat_arrays([column]).buffers():
            digest.update(b"" if buffer is None else memoryview(buffer))
    return digest.intdigest() >> 1


class _Slice:
    """A slice's distinct words by part of the word table, and the place of each word of its texts among them."""

    def __init__(self, own: Words, n: int):
        counts = np.bincount(own.codes, minlength=len(own.distinct))
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]  # frequent words get small numbers
        number = np.zeros(len(counts), "<u4")
        number[order] = np.arange(len(order), dtype="<u4")
        self.words, self.numbers = own.distinct.take(pa.array(order)), number[own.codes]
        self.parts = _buckets(self.words, n)
        self.by = np.argsort(self.parts, kind="stable")
        self.first = np.append(np.flatnonzero(np.diff(self.parts[self.by].astype(np.int64), prepend=-1)), len(self.by))

    def asked(self, key: int) -> pa.RecordBatch:
        """A row for each part of the word table that has words of the slice."""
        first = self.first
        lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), self.words.take(pa.array(self.by)))
        joined = pc.binary_join(lists, pa.scalar("\n", pa.large_string())).cast(pa.large_binary())
        data = pa.array([pa.compress(x.as_buffer(), codec="zstd", asbytes=True) for x in joined], pa.binary())
        part = pa.array(self.parts[self.by[first[:-1]]].astype(np.int32))
        return pa.record_batch([pa.array([key] * len(joined), pa.int64()), part, pc.binary_length(joined).cast(pa.int64()), pa.array(np.diff(first)), data], names=["slice", "part", "size", "words", "data"])


def _plain(docs: DataFrame) -> bool:
    """Whether docs has the same rows in the same order each time: a scan of files or given rows, without a shuffle."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    return plan.deterministic() and all(line.split()[1 if line[0] in "+:" else 0].split("(")[0] in ("Project", "Filter", "Relation", "LocalRelation") for line in plan.toString().strip().splitlines())


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """The columns keep of docs and ids array<int>, as the tokenizer file at path encodes the whole text without adding special tokens.

    With decoded there is also a column of that name, which `decode` would give: one Python process does both.
    path must lead to the file on every executor. Null and empty texts have no ids. Any length of text is encoded whole.
    Rows stand by themselves: repeated rows and repeated or null ids give a row each. Other columns of docs are ignored.
    docs is read twice, first for its words and then for their places; if it isn't a scan, a copy on disk is."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_{i}" for i in range(len(keep))]
    docs = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names, strict=True)), F.col(text).alias("_text"))
    if not _plain(docs):
        docs = materialize(docs, "texts")
    vocabulary = spark.sparkContext.broadcast(pieces(path)) if decoded else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Words]]:
        for batch in batches:
            for a, b, own in parts(batch.column("_text"), slice_bytes):
                rows = batch.slice(a, b - a)
                if len(own.codes):
                    yield _key(rows), rows, own
                else:
                    yield -1, rows, own
            pa.default_memory_pool().release_unused()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, own in split(batches):
            if key >= 0:
                yield _Slice(own, n).asked(key)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            columns: dict[str, list] = {"sizes": [], "ids": [], "n_ids": []}
            for data, size in zip(batch.column("data"), batch.column("size").to_pylist(), strict=True):
                ids = encoder(pa.decompress(data.as_buffer(), size, codec="zstd", asbytes=True).split(b"\n"))
                flat = np.frombuffer(b"".join(ids), "<u4")
                columns["sizes"].append(pack(np.fromiter(map(len, ids), "<u4", len(ids)) // 4))
                columns["ids"].append(pack(flat))
                columns["n_ids"].append(len(flat))
            yield pa.record_batch([batch.column("slice"), batch.column("part"), batch.column("words"), pa.array(columns["sizes"], pa.binary()), pa.array(columns["ids"], pa.binary()), pa.array(columns["n_ids"], pa.int64())], names=["slice", "part", "words", "sizes", "ids", "n_ids"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, own in split(batches):
            sink = pa.BufferOutputStream()
            kept = pa.record_batch([*rows.columns[:-1], pa.nulls(rows.num_rows)], names=rows.schema.names)
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(kept)
            cut = _Slice(own, n)
            columns = {"rows": sink.getvalue().to_pybytes(), "starts": pack(own.starts.astype("<i8")), "numbers": pack(cut.numbers), "parts": pack(cut.parts)}
            yield pa.record_batch({"slice": pa.array([key], pa.int64()), "size": pa.array([len(cut.numbers)], pa.int64()), "words": pa.array([len(cut.parts)], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in columns.items()}})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = pa.array(vocabulary.value, pa.large_string()) if decoded else None
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _assembled({c: batch.column(c)[i].as_py() for c in batch.schema.names}, names, table_of)
            pa.default_memory_pool().release_unused()

    types = dict(docs.dtypes)
    wanted = materialize(docs.mapInArrow(asked, "slice long, part int, size long, words long, data binary"), "words")
    answers = materialize(wanted.repartitionByRange(n, "part").mapInArrow(table, "slice long, part int, words long, sizes binary, ids binary, n_ids long"), "ids")
    discard(wanted)
    answers = answers.groupBy("slice").agg(F.collect_set(F.struct("part", "words", "sizes", "ids", "n_ids")).alias("answers"))
    bodies = docs.mapInArrow(placed, "slice long, size long, words long, rows binary, starts binary, numbers binary, parts binary").join(answers, "slice", "left")
    schema = ", ".join([*(f"{c} {types[c]}" for c in names), "ids array<int>", *["decoded string"] * decoded])
    return bodies.select("size", "words", "rows", "starts", "numbers", "parts", "answers").mapInArrow(joined, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def _assembled(row: dict, names: list[str], table_of: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """The rows of a slice with their ids: the answers of the word table joined with the places of the words."""
    rows = pa.ipc.open_stream(row["rows"]).read_next_batch()
    starts, part = unpack(row["starts"], rows.num_rows + 1, "<i8"), unpack(row["parts"], row["words"], "<u4")
    answers = sorted(row["answers"] or (), key=lambda x: x["part"])
    if [x["part"] for x in answers] != np.unique(part).tolist():
        raise RuntimeError("the texts changed between two reads")
    none = np.zeros(0, "<u4")
    sizes = np.concatenate([none, *(unpack(x["sizes"], x["words"], "<u4") for x in answers)]).astype(np.int64)
    ids = np.concatenate([none, *(unpack(x["ids"], x["n_ids"], "<u4") for x in answers)])
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(ids.view("<i4")))
    place = np.empty(len(part), np.int64)
    place[np.argsort(part, kind="stable")] = np.arange(len(part))
    places = place[unpack(row["numbers"], row["size"], "<u4")]
    for a, b in slices(starts, PART // 8):
        own = places[starts[a] : starts[b]]
        ends = np.concatenate([[0], np.cumsum(sizes[own])])[starts[a : b + 1] - starts[a]]
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lists.take(pa.array(own)).flatten())
        more = [] if table_of is None else [_decoded(out, table_of)]
        yield pa.record_batch([*(c.slice(a, b - a) for c in rows.columns[:-1]), out, *more], names=[*names, "ids", *["decoded"] * len(more)])


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces in order of id; its size bounds the broadcast."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(found.values()) + 1)
    for piece, i in found.items():
        out[i] = piece
    return out


def _decoded(own: pa.Array, table: pa.Array) -> pa.Array:
    """Lists of ids joined with the vocabulary: their pieces, parted by a space."""
    starts = own.offsets.to_numpy().astype(np.int64)
    taken = table.take(own.values.slice(starts[0], starts[-1] - starts[0]))
    made = pa.LargeListArray.from_arrays(pa.array(starts - starts[0], pa.int64()), taken)
    return pc.if_else(own.is_valid(), pc.binary_join(made, pa.scalar(" ", pa.large_string())), pa.scalar(None, pa.large_string())).cast(pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the column out: the pieces of the ids, parted by a space, as a tokenizer without a decoder joins them.

    No ids give an empty text; null ids give null. A column of encoded named like out is replaced."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(pieces(path))
    encoded = encoded.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, `{out}` string"
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(vocabulary.value, pa.large_string())
        for batch in batches:
            lists = batch.column(at)
            for a, b in slices(lists.offsets.to_numpy(), 1_000_000):
                part = batch.slice(a, b - a)
                text = _decoded(part.column(at), table)
                yield pa.record_batch([*part.columns, text], names=[*part.schema.names, out])

    return encoded.mapInArrow(run, schema)
