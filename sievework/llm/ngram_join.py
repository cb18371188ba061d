"""Similarity join of texts by the Jaccard index of their word shingles: a grouped prefix join.

Texts with equal shingle sets form a class. Shingles are ordered by how many texts hold them, rare ones first, so two
similar sets share a shingle of their prefixes. Classes with equal prefixes and sizes form a group; groups that share a
prefix shingle are paired, filtered by size and by counts in hashed bins, expanded to their members and verified on the
whole sets. Long lists of a shingle are first matched against a few leaders: as linked classes are one component already,
only pairs across components are left. These are all compared, block by block within tasks that give only pairs whose bins
allow a link, so no link between components is lost and no list becomes a row for each pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import discard, materialize, threshold_for
from sievework.llm.components import components
from sievework.llm.shingles import shingle_sets

#: A shingle held by so many texts counts as frequent; at most HOT_MOST of the most frequent are broadcast.
HOT_LEAST = 16
HOT_MOST = 1 << 20
#: Lists up to this length are paired in full; longer ones go through leaders first.
SHORT_LIST = 8
LEADERS = 8
#: Members of a list that a task compares with as many others.
BLOCK = 2048
#: Bins of the counting filter.
BINS = 128
#: Bits that say which classes' sets are needed: so many for each class, at most MOST_BITS; a clash only keeps a set too many.
CLASS_BITS = 16
MOST_BITS = 1 << 28
#: Classes whose sets a task remembers to have sent, so that copies send theirs once.
SENT = 200_000
#: Fixed masks that order the members of a list differently for each leader.
MASKS = (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x5851F42D4C957F2D, 0x3C6EF372FE94F82B, 0x14057B7EF767814F, 0x6A09E667F3BCC908, 0x71374491B5C0FBCF, 0x0FC19DC68B8CD5B5)


@dataclass(frozen=True)
class Join:
    """Shingles of k words; two sets link when q * intersection >= p * union."""

    k: int
    p: int
    q: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.p * n // self.q) + 1

    @property
    def region(self) -> np.uint64:
        """Shingles below this hash can be in a prefix unless most of a text is frequent; only these are counted."""
        return np.uint64(min((1 << 64) - 1, (1 << 64) * 3 * (self.q - self.p) // self.q))


def _columns(batch: pa.RecordBatch) -> tuple[list, pa.Array]:
    return batch.column("doc_id").to_pylist(), batch.column("text")


def _pack(values: np.ndarray) -> bytes:
    """Little numbers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def frequent(docs: DataFrame, join: Join) -> DataFrame:
    """(bucket, n): top halves of shingle hashes and how many texts hold them, counted over all texts, n >= HOT_LEAST.

    Each task sends its counts as packed ranges of buckets; a range is added up by one task, and ranges grow in number
    with the session's shuffle partitions."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = (int(join.region) >> 32) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            part = keys.astype(np.int64) * ranges // top
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            rows = [(r, int(b - a), int(keys[a]), _pack(np.diff(keys[a:b], prepend=keys[a])), _pack(counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], names=["part", "size", "least", "deltas", "counts"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), join.k):
                own = own[: np.searchsorted(own, join.region)]
                held.append(np.unique((own >> np.uint64(32)).astype(np.uint32)))
                size += len(own)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add(rows: pa.Table) -> pa.Table:
        keys, counts = [], []
        for r in rows.to_pylist():
            keys.append(np.cumsum(_unpack(r["deltas"], r["size"])) + r["least"])
            counts.append(_unpack(r["counts"], r["size"]))
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        return pa.table({"bucket": distinct[n >= HOT_LEAST], "n": n[n >= HOT_LEAST]})

    return docs.select("text").mapInArrow(count, "part long, size long, least long, deltas binary, counts binary").groupBy("part").applyInArrow(add, "bucket long, n long")


def class_id(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _counts(bins: list[bytes]) -> np.ndarray:
    """Counts in bins as rows."""
    kinds = {len(x) for x in bins}
    if kinds == {BINS}:
        return np.frombuffer(b"".join(bins), "<u1").reshape(-1, BINS)
    return np.array([np.frombuffer(x, "<u1" if len(x) == BINS else "<u4") for x in bins], "<u4").reshape(-1, BINS)


def _bins(own: np.ndarray) -> bytes:
    counts = np.bincount((own >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS)
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def signatures(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, mark, cid, n, gkey, bins, tokens): a hash of the text, and the class, size, group, bins and prefix of each text's set; cid is null without shingles."""
    hot = materialize(frequent(docs, join), "hot")
    found = hot.where(F.col("n") >= max(HOT_LEAST, threshold_for(hot, "n", HOT_MOST))).toArrow()
    order = np.argsort(found.column("bucket").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast((found.column("bucket").to_numpy()[order].astype(np.uint32), found.column("n").to_numpy()[order].astype(np.int32)))
    discard(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = sent.value
        for batch in batches:
            ids, texts = _columns(batch)
            rows: list[tuple] = []
            for doc_id, mark, own in zip(ids, batch.column("mark").to_pylist(), shingle_sets(texts, join.k), strict=True):
                n = len(own)
                if not n:
                    rows.append((doc_id, mark, None, 0, None, None, None))
                    continue
                keys = (own >> np.uint64(32)).astype(np.uint32)
                held = np.zeros(n, np.int32)
                if len(buckets):
                    at = np.minimum(np.searchsorted(buckets, keys), len(buckets) - 1)
                    held = np.where(buckets[at] == keys, counts[at], 0)
                held[own >= join.region] = np.iinfo(np.int32).max  # not counted, so perhaps frequent: these come last
                prefix = own[np.argsort(held, kind="stable")[: join.prefix(n)]]
                group = hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest()
                rows.append((doc_id, mark, class_id(own), n, int.from_bytes(group, "little", signed=True), _bins(own), (prefix & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], names=["doc_id", "mark", "cid", "n", "gkey", "bins", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, cid long, n long, gkey long, bins binary, tokens array<int>")


class _Verifier:
    """Checks pairs (a, b) of classes and gives those that link."""

    def __init__(self, docs: DataFrame, classes: DataFrame, join: Join):
        self.docs, self.classes, self.join = docs, classes, join
        self.sets: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs of which the sizes and the bins let the sets link."""
        p, q = self.join.p, self.join.q
        info = self.classes.select("cid", "n", "bins")
        left = info.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba"))
        right = info.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb"))
        both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    most = np.minimum(_counts(batch.column("ba").to_pylist()), _counts(batch.column("bb").to_pylist())).sum(1, dtype=np.int64)
                    fine = pa.array((p + q) * most >= p * (batch.column("na").to_numpy() + batch.column("nb").to_numpy()))
                    yield pa.record_batch([batch.column("a").filter(fine), batch.column("b").filter(fine)], names=["a", "b"])

        return both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")

    def gather(self, cids: DataFrame) -> None:
        """Computes the sets of the classes once more from their texts; a bitmap of bounded size says which are needed."""
        spark = self.docs.sparkSession
        need = materialize(cids.select("cid").distinct(), "need")
        n_bits = 1 << 16
        while n_bits < min(MOST_BITS, CLASS_BITS * need.count()):
            n_bits *= 2
        marks = need.select((F.pmod("cid", F.lit(n_bits)) + 1).alias("h"))
        rows = marks.groupBy(F.expr("bitmap_bucket_number(h)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).toArrow()
        bitmap = np.zeros(n_bits // 8 + (1 << 13), np.uint8)
        for bucket, bits in zip(rows.column("at").to_pylist(), rows.column("bits"), strict=True):
            own = np.frombuffer(bits.as_buffer(), np.uint8)
            bitmap[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(own)] = own
        sent = spark.sparkContext.broadcast(bitmap)
        k = self.join.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            seen: set[int] = set()
            cids, blobs, size = [], [], 0

            def flush() -> pa.RecordBatch:
                return pa.record_batch([pa.array(cids, pa.int64()), pa.array(blobs, pa.binary())], names=["cid", "own"])

            for batch in batches:
                for own in shingle_sets(batch.column("text"), k):
                    if not len(own):
                        continue
                    cid = class_id(own)
                    at = cid % n_bits
                    if not wanted[at >> 3] >> (at & 7) & 1 or cid in seen:
                        continue
                    if len(seen) >= SENT:
                        seen.clear()
                    seen.add(cid)
                    cids.append(cid)
                    blobs.append(own.tobytes())
                    size += len(blobs[-1])
                    if size > 16 << 20:
                        yield flush()
                        cids, blobs, size = [], [], 0
            yield flush()

        found = self.docs.select("text").mapInArrow(run, "cid long, own binary").join(need, "cid", "left_semi")
        self.sets = materialize(found.dropDuplicates(["cid"]), "sets")
        discard(need)

    def links(self, pairs: DataFrame) -> DataFrame:
        p, q = self.join.p, self.join.q
        left = self.sets.select(F.col("cid").alias("a"), F.col("own").alias("x"))
        right = self.sets.select(F.col("cid").alias("b"), F.col("own").alias("y"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([u, v])
                    both.sort()
                    o = int((both[1:] == both[:-1]).sum())
                    fine.append(q * o >= p * (len(u) + len(v) - o))
                fine = pa.array(fine, pa.bool_())
                yield pa.record_batch([batch.column("a").filter(fine), batch.column("b").filter(fine)], names=["a", "b"])

        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _bits(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of bits, one for each number that at least two lists hold."""
    encoded = lists.flatten().dictionary_encode()
    number, row = encoded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    often = np.bincount(number, minlength=len(encoded.dictionary)) > 1
    place = np.cumsum(often) - 1
    number, row = place[number[often[number]]], row[often[number]]
    out = np.zeros((len(lists), max(1, -(-int(often.sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
    return out


def _led(lists: DataFrame) -> DataFrame:
    """(a, b): the leaders of each token's list with its other members; each mask gives a leader."""
    leaders = lists.groupBy("token").agg(*(F.min(F.col("cid").bitwiseXOR(F.lit(m))).alias(f"l{i}") for i, m in enumerate(MASKS)))
    each = F.explode(F.array_distinct(F.array(*(F.col(f"l{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(MASKS)))))
    return lists.join(leaders, "token").select(each.alias("a"), F.col("cid").alias("b")).where(F.col("a") != F.col("b"))


def _across(lists: DataFrame, labels: DataFrame, classes: DataFrame, join: Join, block: int) -> DataFrame:
    """(a, b): all pairs of members of a list (token, cid) in different components that sizes and bins let link.

    Of any such pair one at least is outside the list's largest component; these few are dealt to blocks, all members to
    others, and a task compares one block with another. A pair that shares several lists is given by the first of them."""
    p, q = join.p, join.q
    placed = lists.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    blocks = lambda c: F.ceil(c / block).cast("int")
    main = main.select("token", F.col("top.component").alias("main"), blocks(F.col("all") - F.col("top.size")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    own = placed.groupBy("cid").agg(F.collect_set("token").alias("tokens"))
    every = placed.join(main, "token").join(classes.select("cid", "n", "bins"), "cid").join(own, "cid")
    every = every.withColumn("tokens", F.filter("tokens", lambda t: t < F.col("token")))
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    range_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["token", "left", "right", "few", "cid", "n", "component", "bins", "tokens"]
    few = every.where(F.col("component") != F.col("main")).withColumns({"left": deal("lefts"), "few": F.lit(True)}).withColumn("right", range_("rights")).select(*columns)
    all_ = every.withColumns({"right": deal("rights"), "few": F.lit(False)}).withColumn("left", range_("lefts")).select(*columns)

    def compare(part: pa.Table) -> pa.Table:
        few = part.column("few").to_numpy()
        x, y = np.flatnonzero(few), np.flatnonzero(~few)
        cid, n, component = (part.column(c).to_numpy() for c in ("cid", "n", "component"))
        counts = _counts(part.column("bins").to_pylist())
        earlier = _bits(part.column("tokens").combine_chunks())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), 32):
            own = x[at : at + 32]
            fits = (component[own, None] != component[y]) & (np.minimum(n[own, None], n[y]) * q >= np.maximum(n[own, None], n[y]) * p)
            i, j = np.nonzero(fits)
            for s in range(0, len(i), 1 << 16):
                u, v = own[i[s : s + (1 << 16)]], y[j[s : s + (1 << 16)]]
                here = ~(earlier[u] & earlier[v]).any(1)
                u, v = u[here], v[here]
                most = np.minimum(counts[u], counts[v]).sum(1, dtype=np.int64)
                fine = (p + q) * most >= p * (n[u] + n[v])
                found.append((cid[u[fine]], cid[v[fine]]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*found, strict=True) if found else ((), ())))
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    pairs = few.unionByName(all_).groupBy("token", "left", "right").applyInArrow(compare, "a long, b long").distinct()
    pairs = materialize(pairs, "pairs")
    discard(placed)
    return pairs


def link_classes(docs: DataFrame, classes: DataFrame, join: Join, block: int = BLOCK) -> DataFrame:
    """(id, component) of all classes (cid, n, gkey, bins, tokens, least) that link with another."""
    p, q = join.p, join.q
    groups = classes.groupBy("gkey").agg(F.min("cid").alias("gid"))
    members = materialize(classes.select("cid", "gkey").join(groups, "gkey").select("cid", "gid"), "members")
    heads = classes.join(members.where(F.col("cid") == F.col("gid")).select("cid"), "cid")
    postings = heads.select(F.explode(F.col("tokens").cast("array<bigint>")).alias("token"), F.col("cid").alias("gid"), F.col("n").cast("int").alias("n"))
    lengths = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    lists = materialize(postings.join(lengths, "token"), "lists")
    short, long_ = lists.where(F.col("size") <= SHORT_LIST), lists.where(F.col("size") > SHORT_LIST)
    x, y = short.alias("x"), short.alias("y")
    fits = (F.least(F.col("x.n"), F.col("y.n")) * q >= F.greatest(F.col("x.n"), F.col("y.n")) * p) & (F.col("x.gid") < F.col("y.gid"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct()
    # the members of a group, and those of two large groups, are lists of their own; a clash of their names only adds pairs
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    sized = pairs.join(sizes.select(F.col("gid").alias("a"), F.col("m").alias("ma")), "a").join(sizes.select(F.col("gid").alias("b"), F.col("m").alias("mb")), "b")
    sized = materialize(sized, "groups")
    few = sized.where(F.col("ma") * F.col("mb") <= SHORT_LIST)
    named = lambda sign, *c: sign * (F.lit(1 << 40) + F.pmod(F.xxhash64(*c), F.lit(1 << 61)))
    many = sized.where(F.col("ma") * F.col("mb") > SHORT_LIST).select(named(1, "a", "b").alias("token"), F.explode(F.array("a", "b")).alias("gid"))
    own = sizes.where(F.col("m") > 1).select(named(-1, "gid").alias("token"), "gid")
    listed = long_.select("token", "gid").unionByName(many).unionByName(own).join(members, "gid").select("token", "cid")
    listed = materialize(listed, "long")
    expand = lambda s: members.select(F.col("gid").alias(s), F.col("cid").alias(f"{s}_cid"))
    pairs = few.join(expand("a"), "a").join(expand("b"), "b").select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))
    verifier = _Verifier(docs, classes, join)
    ordered = pairs.unionByName(_led(listed)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(verifier.likely(ordered), "pairs")
    discard(lists, members, sized)
    verifier.gather(pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(listed.select("cid")))
    links = materialize(verifier.links(pairs), "links")
    discard(pairs)
    labels = components(links)
    pairs = _across(listed, labels, classes, join, block)
    discard(listed)
    if pairs.isEmpty():
        discard(pairs, links, verifier.sets)
        return labels
    more = materialize(links.unionByName(verifier.links(pairs)), "links")
    discard(pairs, links, labels, verifier.sets)
    labels = components(more)
    discard(more)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all docs (doc_id, text): links join texts whose shingle sets have a Jaccard index of percent / 100 or more.

    Words are runs without ASCII white space, with A-Z lower-cased. A text of fewer than k words is one shingle; null, empty
    and blank texts have none and link with nothing. component_id is the smallest doc_id reachable by links, the own one
    included; null ids take part in links but name a component only if it has no other. Repeated rows give a row each.
    Classes are known by 64-bit hashes of their sets, shingles by 64-bit hashes of their words."""
    signed, named = _components(docs, Join(k, percent), block)
    out = signed.select("doc_id", "cid", "n").join(named.select("cid", F.col("least.doc_id").alias("component_id")), "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _components(docs: DataFrame, join: Join, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and of each class (cid) the least row of its component: no_id, doc_id and mark, a hash of the text."""
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, join), "signatures")
    # equal cids have equal values in all other columns, so any of them will do
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    classes = signed.where(F.col("cid").isNotNull()).groupBy("cid").agg(least, F.min("n").alias("n"), F.min("gkey").alias("gkey"), F.min("bins").alias("bins"), F.min("tokens").alias("tokens"))
    classes = materialize(classes, "classes")
    labels = link_classes(docs, classes, join, block)
    placed = classes.select("cid", "least").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = placed.groupBy("component").agg(F.min("least").alias("least"))
    named = materialize(placed.select("cid", "component").join(named, "component").select("cid", "least"), "named")
    rows = materialize(signed.select("doc_id", "mark", "cid", "n"), "rows")
    discard(labels, classes, signed)
    return rows, named


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component one row stays, that of its smallest doc_id.

    Null ids come last, and among rows of one id the text with the smaller hash comes first; of rows equal in both, any one
    stays. Texts without shingles link with nothing and stay."""
    signed, named = _components(docs, Join(k, percent))
    keys = signed.where(F.col("cid").isNotNull()).select("doc_id", "mark", "cid").join(named, "cid")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    gone = keys.where(~first).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    again = keys.where(first).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("_id", "_mark")
    again = materialize(again, "again")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, same).groupBy("_id", "_mark").agg(F.first(F.struct(*(F.col(c) for c in docs.columns))).alias("row")).select("row.*")
    return left.join(again, same, "left_anti").unionByName(once)
