"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors form a class. Classes of a label are dealt to overlapping shards, those of their nearest centroids. In each
shard a flat graph is built by robust pruning; a class's lists of all its shards are united. Range searches then start at a
shard's medoid, go greedily towards the query and, once in range, expand to all neighbours in range. Every hit is verified
in double precision. Each shard audits its recall on some queries and searches wider, exactly at last, until it is high enough. A pair is
counted in the first shard that both share, and a shard returns counts and a spanning forest, so no group's pairs are rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import materialize
from sievework.llm.components import components

#: Classes in a shard, about; labels with fewer need no centroids.
SHARD = 1500
#: Most centroids of all labels together, and sampled classes for each of them; both bound what the driver holds.
MOST_CENTROIDS = 8192
SAMPLE_EACH = 32
#: Shards that hold a class.
OVERLAP = 2
#: A larger shard is cut into blocks of about so many classes, and all pairs of its blocks are searched.
BLOCK = 4096
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 24
#: Vectors so far below the threshold are still expanded in a range search.
SLACK = 0.05
AUDIT_QUERIES = 32
AUDIT_RECALL = 0.98


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centers)
    return centers


def build(v: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """A robust-pruned flat graph over unit vectors: for each its neighbours, the reverse edges of pruned lists included."""
    n = len(v)
    out: list[list[int]] = [[] for _ in range(n)]
    rng = np.random.default_rng(n)
    for at in range(0, n, 512):
        sims = v[at : at + 512] @ v.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        most = min(candidates, n - 1)
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most else np.zeros((len(sims), 0), np.int64)
        for i, row in enumerate(near):
            far = rng.integers(0, n, 8)  # some long edges keep the graph navigable
            pool = np.unique(np.concatenate([row, far[far != at + i]]))
            gap = np.sqrt(np.maximum(2 - 2 * sims[i, pool], 0))
            order = np.argsort(gap, kind="stable")
            pool, gap = pool[order], gap[order]
            between = np.sqrt(np.maximum(2 - 2 * (v[pool] @ v[pool].T), 0))
            left = np.ones(len(pool), bool)
            for j in range(len(pool)):
                if left[j]:
                    out[at + i].append(int(pool[j]))
                    if len(out[at + i]) >= degree:
                        break
                    left &= alpha * between[j] > gap
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own:
            if len(back[j]) < degree:
                back[j].append(i)
    return [np.unique(np.array(a + b, np.int64)) for a, b in zip(out, back, strict=True)]


def search(v: np.ndarray, graph: list[np.ndarray], start: int, q: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Indices of vectors with a similarity to q of least or more, by greedy search from start and expansion in range."""
    seen = np.zeros(len(v), bool)
    sims = np.full(len(v), -2.0)
    seen[start] = True
    sims[start] = v[start] @ q
    heap, best = [(-sims[start], start)], [sims[start]]
    while heap:
        s, i = heapq.heappop(heap)
        if len(best) >= beam and -s < best[0] and -s < least:
            break
        new = graph[i][~seen[graph[i]]]
        if not len(new):
            continue
        seen[new] = True
        sims[new] = v[new] @ q
        for j, x in zip(new.tolist(), sims[new].tolist(), strict=True):
            if len(best) < beam or x > best[0] or x >= least:
                heapq.heappush(heap, (-x, j))
                if x < least:
                    (heapq.heappush if len(best) < beam else heapq.heappushpop)(best, x)
        if -s >= least:  # in range: from here on everything in range or close to it is expanded at once
            front = np.flatnonzero(sims >= least - SLACK)
            while len(front):
                near = np.unique(np.concatenate([graph[j] for j in front.tolist()]))
                near = near[~seen[near]]
                seen[near] = True
                sims[near] = v[near] @ q
                front = near[sims[near] >= least - SLACK]
            break
    return np.flatnonzero(sims >= least)


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw): rows that can link."""
    raw = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("raw", lambda x: x != 0), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", raw.alias("raw")).withColumn("fine", fine & F.col("label").isNotNull())


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all vectors (vec_id, label, embedding).

    Vectors of equal label (not null) and length link at a cosine of least or more, in double precision. Null, empty and
    zero vectors and those with a null or non-finite component link with nothing and keep their own id. Equal vectors are
    linked copies; repeated ids count as rows of their own. A null vec_id names no component and is kept only by a null one.
    Classes are known by 64-bit hashes."""
    spark = vectors.sparkSession
    rows = materialize(_valid(vectors).withColumn("cid", F.when(F.col("fine"), F.xxhash64("label", "raw"))), "vectors")
    classes = rows.where("fine").groupBy("cid").agg(F.first("label").alias("label"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least_id"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    big = F.array_max(F.transform("raw", lambda x: F.abs(x)))
    classes = classes.withColumn("raw", F.transform("raw", lambda x: x / big))  # no square over- or underflows
    classes = classes.withColumn("_norm", norm(F.col("raw"))).withColumn("v", F.transform("raw", lambda x: x / F.col("_norm")))
    classes = materialize(classes.select("cid", F.xxhash64("label", F.size("raw")).alias("space"), "v", "m", "least_id"), "classes")
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    total = classes.count()
    each = max(shard, -(-OVERLAP * total // MOST_CENTROIDS))
    large = {r["space"]: (-(-OVERLAP * r["n"] // each), r["n"]) for r in sizes.where(F.col("n") > each).collect()}
    centers: dict[int, np.ndarray] = {}
    if large:
        share = F.coalesce(*(F.when(F.col("space") == s, F.lit(SAMPLE_EACH * k / n)) for s, (k, n) in large.items()), F.lit(0.0))
        drawn = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < share * 1_000_000).select("space", "v").toArrow()
        space = drawn.column("space").to_numpy()
        found = drawn.column("v").to_pylist()
        for s, (k, _) in large.items():
            own = np.array([found[i] for i in np.flatnonzero(space == s)])
            if len(own):
                centers[s] = centroids(own, k)
    sent = spark.sparkContext.broadcast(centers)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for s, v in zip(batch.column("space").to_pylist(), batch.column("v").to_pylist(), strict=True):
                c = sent.value.get(s)
                own.append([0] if c is None else sorted(np.argsort(-(c @ np.array(v)), kind="stable")[:OVERLAP].tolist()))
            yield pa.record_batch([*batch.columns, pa.array(own, pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"])

    dealt = materialize(classes.select("cid", "space", "v", "m").mapInArrow(deal, "cid long, space long, v array<double>, m long, shards array<long>"), "dealt")
    spread = dealt.withColumn("shard", F.explode("shards"))
    blocks = spread.groupBy("space", "shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    spread = spread.join(blocks, ["space", "shard"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("blocks")))

    def shard_graph(part: pa.Table) -> pa.Table:
        cids = part.column("cid").to_numpy()
        graph = build(np.array(part.column("v").to_pylist()))
        return pa.table({"cid": part.column("cid"), "near": pa.array([cids[g] for g in graph], pa.list_(pa.int64()))})

    lists = spread.select("space", "shard", "part", "cid", "v").groupBy("space", "shard", "part").applyInArrow(shard_graph, "cid long, near array<long>")
    united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = materialize(spread.join(united, "cid"), "graph")
    # a block is searched by all blocks of its shard: queries of block `by` among the nodes of block `part`
    jobs = nodes.withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("query", F.col("by") == F.col("part"))
    queries = nodes.where(F.col("blocks") > 1).withColumn("by", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    queries = queries.where(F.col("by") != F.col("part")).withColumn("query", F.lit(True)).withColumn("node", F.lit(False))
    jobs = jobs.withColumn("node", F.lit(True)).unionByName(queries)

    def find(key: tuple, part: pa.Table) -> pa.Table:
        own = key[1].as_py()
        cids, m = part.column("cid").to_numpy(), part.column("m").to_numpy()
        v = np.array(part.column("v").to_pylist())
        shards = [set(s) for s in part.column("shards").to_pylist()]
        node, query = np.flatnonzero(part.column("node").to_numpy(zero_copy_only=False)), np.flatnonzero(part.column("query").to_numpy(zero_copy_only=False))
        node = node[np.argsort(cids[node])]
        known, near = cids[node], part.column("near").to_pylist()
        graph = []
        for i in node.tolist():
            at = np.minimum(np.searchsorted(known, near[i]), len(known) - 1)
            graph.append(np.unique(at[known[at] == np.array(near[i], np.int64)]).astype(np.int64))
        nv = np.ascontiguousarray(v[node])
        start = int((nv @ nv.mean(0)).argmax())
        audit = query[:: max(1, len(query) // AUDIT_QUERIES)][:AUDIT_QUERIES]
        truth = [np.setdiff1d(known[nv @ v[i] >= least], cids[i]) for i in audit.tolist()]
        asked = [(i, t) for i, t in zip(audit.tolist(), truth, strict=True) if len(t)]
        beam = BEAM
        while beam < len(node):
            # each query counts alike, so a large group does not hide what small ones miss
            got = [np.isin(t, known[search(nv, graph, start, v[i], least, beam)]).mean() for i, t in asked]
            if sum(got) >= AUDIT_RECALL * len(asked):
                break
            beam *= 2
        # a shard that no beam serves is searched exactly
        hits = (lambda q: search(nv, graph, start, q, least, beam)) if beam < len(node) else (lambda q: np.flatnonzero(nv @ q >= least))
        parent = {}

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        counts = np.zeros(len(cids), np.int64)
        for i in query.tolist():
            for j in node[hits(v[i])].tolist():
                if cids[i] == cids[j]:
                    continue
                if own == min(shards[i] & shards[j]):
                    counts[i] += m[j]
                a, b = root(int(cids[i])), root(int(cids[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        hit = query[counts[query] > 0]
        tree = [(c, root(c)) for c in parent if root(c) != c]
        return pa.table({"cid": pa.array([*cids[hit].tolist(), *(a for a, _ in tree)], pa.int64()), "n": pa.array([*counts[hit].tolist(), *[0] * len(tree)], pa.int64()), "to": pa.array([*[None] * len(hit), *(b for _, b in tree)], pa.int64())})

    found = jobs.select("space", "shard", "part", "by", "cid", "v", "m", "shards", "near", "node", "query").groupBy("space", "shard", "part", "by").applyInArrow(find, "cid long, n long, to long")
    found = materialize(found, "found")
    links = found.groupBy("cid").agg(F.sum("n").alias("links"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    placed = classes.select("cid", "m", "least_id").join(links, "cid", "left").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = materialize(placed.join(named, "component").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, found: DataFrame, least: float = 0.98, queries: int = 200) -> float:
    """The share of true links of about `queries` vectors, by brute force over all rows, that found's n_links has.

    Rows without an id are not asked for, but are found."""
    rows = _valid(vectors).where("fine")
    n = max(1, rows.count())
    asked = rows.where(F.col("vec_id").isNotNull() & (F.pmod(F.xxhash64("vec_id"), F.lit(n)) < queries)).select("vec_id", "label", "raw").collect()
    sent = vectors.sparkSession.sparkContext.broadcast([(r["vec_id"], r["label"], np.array(r["raw"])) for r in asked])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, raw = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), [np.array(x) for x in batch.column("raw").to_pylist()]
            for i, lab, q in sent.value:
                hits = sum(j != i and o == lab and len(r) == len(q) and r @ q / np.sqrt((r @ r) * (q @ q)) >= least for j, o, r in zip(ids, labels, raw, strict=True))
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([hits], pa.int64())], names=["vec_id", "n"])

    true = rows.select("vec_id", "label", "raw").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("got")).first()
    return (both["got"] or 0) / both["n"] if both["n"] else 1.0
