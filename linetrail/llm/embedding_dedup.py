"""Near-duplicate vectors by navigable small-world graphs.

Equal vectors are one class.  The classes are dealt over shards of about
``SHARD_VALUES`` components by hash; each shard gets a graph (``hnsw``), and every class
queries every shard.  Two audits set the beam, which is doubled until both find ``RECALL``.  One is made for the shard: ``PLANTED`` of its vectors,
each turned by a random angle that keeps a cosine of ``least`` or more, have to lead back to where they came from, so there is
evidence where no links are.  The other runs with the queries: ``AUDIT`` of each block are compared with all vectors of the
shard, and links found and links there are pooled over the blocks.  Only a shard where the widest beam fails is
compared exactly from then on.  Cosines of all that is found
are computed again in double precision, and links connect components by
distributed union-find.

What leaves a task is a count and the links that connect for each query, not every pair,
so a large group of similar vectors costs rows in proportion to its
size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do vectors of different lengths; ``n_links`` counts copies one by one; ``component`` is
the smallest non-null id reachable; rows that repeat an id are vectors of their own; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .common import written
from .components import connected_components

#: Components of a shard's vectors: what one task holds.  Every vector queries every shard, so few large ones are best.
SHARD_VALUES = 1 << 22
BEAM = 16
#: Queries of each block that are compared with all vectors of a shard.
AUDIT = 128
PLANTED = 512
RECALL = 0.99
#: A shard's graph is copied for so many groups of query blocks, which are then searched side by side.
COPIES = 4
QUERIES = 4096


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def _shards(classes: DataFrame, n: int) -> DataFrame:
    """One row for each shard and length of vectors: ``shard, dim, ids, weights, vectors, graph``."""
    rows = classes.select(F.pmod(F.xxhash64("rep"), F.lit(n)).alias("shard"), F.size("embedding").alias("dim"), "rep", "n", "embedding")
    names = ["shard", "dim", "ids", "weights", "vectors", "graph"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def built():
            ids, weights = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            x = np.concatenate([p[2] for p in parts])
            graph = hnsw.Graph.build(hnsw.unit(x), seed=int(now[0]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                [now[0], now[1], ids.tobytes(), weights.tobytes(), x.tobytes(), hnsw.pack(graph)],
                [pa.int64(), pa.int64(), *[pa.binary()] * 4])], names)
        for batch in batches:
            shard, dim = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "dim"))
            ids, weights = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n"))
            flat, at = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dim)])
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1])) + 1), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = (int(shard[a]), int(dim[a]))
                if key != now and parts:
                    yield built()
                    parts = []
                now = key
                parts.append((ids[a:b], weights[a:b], flat[at[a]:at[b]].astype(np.float64).reshape(b - a, -1)))
        if parts:
            yield built()
    return rows.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "rep") \
        .mapInArrow(run, "shard long, dim long, ids binary, weights binary, vectors binary, graph binary")


class Audited:
    """Searches of one shard's graph, with the beam that the audits ask for; none where the widest fails."""

    def __init__(self, graph: hnsw.Graph, ids: np.ndarray, x: np.ndarray, least: float):
        self.graph, self.ids, self.x, self.least = graph, ids, x, least
        self.beam, self.pools, self.searched = BEAM, {}, 0
        places, q = self._planted()
        near = [set(p.tolist()) for p in self._exact(q)] if self.beam < len(x) else []
        there = np.array([i in p for i, p in zip(places.tolist(), near)], dtype=bool)
        self._widen(lambda got: (int(there.sum()), sum(i in p for i, p, ok in zip(places.tolist(), got, there) if ok)), q)

    def _planted(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(0)
        places = rng.choice(len(self.x), min(PLANTED, len(self.x)), replace=False)
        x = self.x[places]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        cos = rng.uniform(self.least, 1, (len(x), 1))
        return places, hnsw.unit(cos * x + np.sqrt(1 - cos * cos) * np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9))

    def _exact(self, q: np.ndarray) -> list[np.ndarray]:
        return [np.flatnonzero(near) for at in range(0, len(q), AUDIT) for near in q[at:at + AUDIT] @ self.x.T >= self.least]

    def _widen(self, count, q: np.ndarray) -> None:
        """Double the beam until its pooled audits, with what ``count`` sees now (links there, links found), pass."""
        while self.beam and self.beam < len(self.x):
            there, hit = self.pools.get(self.beam, (0, 0))
            now = count(self.graph.within(q, self.least, self.beam))
            there, hit = there + now[0], hit + now[1]
            self.pools[self.beam] = (there, hit)
            if hit >= RECALL * there:
                return
            self.beam *= 2
        self.beam = 0

    def find(self, qids: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """Places in the shard of what each query is linked to, a query itself among them or not."""
        if not self.beam:
            return self._exact(q)
        order = np.random.default_rng(int(qids[0]) & 0xFFFF).permutation(len(q))
        some, rest = order[:AUDIT], order[AUDIT:]
        true = self._exact(q[some])

        def others(places):
            return sum(int((self.ids[p] != qids[i]).sum()) for i, p in zip(some, places))
        self._widen(lambda got: (others(true), others(got)), q[some])
        if self.beam:
            self.searched += len(rest)
        found = true + (self.graph.within(q[rest], self.least, self.beam) if self.beam else self._exact(q[rest]))
        return [found[i] for i in np.argsort(order)]


def _found(graph: hnsw.Graph, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, least: float) -> list[np.ndarray]:
    """``Audited.find`` for one block alone."""
    return Audited(graph, ids, x, least).find(qids, q)


def _answers(shards: DataFrame, n: int, least: float) -> DataFrame:
    """``(a, b, w)``: with ``b`` null, ``w`` vectors in one shard are linked to ``a``; else a link that connects."""
    none = F.lit(None).cast("binary")
    graphs = shards.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("g"), F.lit(-1).cast("long").alias("q"),
                           "ids", "weights", "vectors", "graph")
    # Blocks of QUERIES vectors of each shard go to every shard.
    blocks = shards.select(F.col("shard").alias("own"), "dim", "ids", "vectors", F.explode(F.sequence(
        F.lit(0), F.ceil(F.length("ids") / (8 * QUERIES)).cast("int") - 1)).alias("part"))

    def part_of(c, width):
        return F.substring(c, F.col("part") * width + 1, width)
    queries = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"), "dim",
                            F.pmod(F.col("own") + F.col("part"), F.lit(COPIES)).cast("int").alias("g"), F.col("own").alias("q"),
                            part_of("ids", F.lit(8 * QUERIES)).alias("ids"), none.alias("weights"),
                            part_of("vectors", (F.col("dim") * 8 * QUERIES).cast("int")).alias("vectors"), none.alias("graph"))
    rows = graphs.union(queries).repartition("shard", "dim", "g").sortWithinPartitions("shard", "dim", "g", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            a_out, b_out, w_out = [], [], []
            for row in batch.to_pylist():
                vec = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                if row["q"] < 0:
                    ids, weights, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64), hnsw.unit(vec)
                    shard, key = Audited(hnsw.unpack(row["graph"], x), ids, x, least), (row["shard"], row["dim"], row["g"])
                    continue
                if shard is None or key != (row["shard"], row["dim"], row["g"]):
                    continue  # the shard has no vectors of this length
                qids = np.frombuffer(row["ids"], np.int64)
                up: dict[int, int] = {}

                def find(i):
                    while up.setdefault(i, i) != i:
                        up[i] = i = up[up[i]]
                    return i
                for a, places in zip(qids.tolist(), shard.find(qids, hnsw.unit(vec))):
                    near = ids[places]
                    places, near = places[near != a], near[near != a]
                    if len(near):
                        a_out.append(a)
                        b_out.append(None)
                        w_out.append(int(weights[places].sum()))
                        for b in near.tolist():
                            r, s = find(a), find(b)
                            if r != s:
                                up[max(r, s)] = min(r, s)
                for i in up:
                    if find(i) != i:
                        a_out.append(i)
                        b_out.append(find(i))
                        w_out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(w_out, pa.int64())], ["a", "b", "w"])
    return rows.mapInArrow(run, "a long, b long, w long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each input row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    good = rows.where(usable(F.col("embedding")))
    classes = written(good.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
                      .withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    n = max(1, -(-(classes.agg(F.sum(F.size("embedding"))).first()[0] or 0) // SHARD_VALUES))
    shards = written(_shards(classes, n), "vector-shards")
    answers = written(_answers(shards, n, least), "vector-answers")
    found = connected_components(answers.where("b is not null").select("a", "b"))
    counts = answers.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    named = classes.join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("embedding", "least", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component"))
    named = named.join(smallest, "c").select("embedding", "n_links", "component")
    out = rows.withColumn("ok", usable(F.col("embedding")))
    linked = out.where("ok").join(named, "embedding").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = out.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
