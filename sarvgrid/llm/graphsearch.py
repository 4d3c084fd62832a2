"""Approximate nearest neighbours by a robustly pruned directed graph.

Vectors are dealt to shards of bounded size by a hash of their ids, so no key's rows meet in one shard. In a shard each
distinct vector is a node. Nodes are put into the graph in batches: a greedy beam search from the medoid proposes
neighbours, and robust pruning keeps one only if no kept one is closer to it by a factor ``alpha``; edges go
both ways and are pruned again where a node gets too many. A query runs a beam search in each shard, whose beam doubles until that
no longer changes what was nearest; distances of what it finds are recomputed in double precision on the original vectors, and the
nearest of all shards are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle
from .words import release

#: Vectors in a shard (about) and their bytes at most, edges of a node, beams of building and first one of searching, pruning factor.
SHARD, SHARD_BYTES, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 50_000, 64 << 20, 32, 48, 48, 1.2
#: Nodes that a search opens at once, the most that a beam grows to, and nodes or queries that take steps together.
OPEN, POOL, TOGETHER = 4, 512, 512
#: Bytes of query vectors that are sent to all shards at once.
QUERY_BYTES = 32 << 20


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, pool: int = 0, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, squared distances), nearest first, of a beam search for each query, -1 filling the rest; and nodes looked at.

    All queries take a step together: each opens the nearest of its ``beam`` best nodes not opened yet and looks at their edges. A
    query that is done goes on with twice the beam, up to ``pool``, while that changed its ``k`` nearest.
    """
    n, m, pool = len(points), len(queries), max(beam, pool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    node, dist, opened = np.full((m, pool), n, np.int32), np.full((m, pool), np.inf, np.float32), np.ones((m, pool), bool)
    node[:, 0], dist[:, 0], opened[:, 0], seen[:, start] = start, ((queries - points[start]) ** 2).sum(1), False, True
    wide, last, looked = np.full(m, beam), np.full(m, np.inf), np.ones(m, np.int64)
    live = np.arange(m)
    while len(live):
        row = np.arange(len(live))[:, None]
        # pools are kept sorted: the beam is their beginning
        waiting = ~opened[live] & (np.arange(pool) < wide[live, None])
        turn = np.cumsum(waiting, axis=1)
        turn[~waiting] = 0
        take = waiting & (turn <= OPEN)
        r, c = np.nonzero(take)
        opened[live[r], c] = True
        near = edges[node[live[r], c]]
        r = np.repeat(r, near.shape[1])
        near = near.ravel()
        fresh = np.flatnonzero(~seen[live[r], near])
        code = np.unique(r[fresh].astype(np.int64) * (n + 1) + near[fresh])  # a node that two opened ones lead to counts once
        r, near = code // (n + 1), (code % (n + 1)).astype(np.int32)
        seen[live[r], near] = True
        count = np.bincount(r, minlength=len(live))
        looked[live] += count
        away = points[near]
        away -= queries[live[r]]
        d = np.einsum("ij,ij->i", away, away)
        new_d = np.full((len(live), max(1, int(count.max(initial=0)))), np.inf, np.float32)
        new_n = np.full(new_d.shape, n, np.int32)
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        new_d[r, place], new_n[r, place] = d, near
        all_d, all_n = np.hstack([dist[live], new_d]), np.hstack([node[live], new_n])
        all_o = np.hstack([opened[live], new_n == n])
        best = np.argsort(all_d, axis=1, kind="stable")[:, :pool]
        dist[live], node[live], opened[live] = all_d[row, best], all_n[row, best], all_o[row, best]
        done = ~(~opened[live] & (np.arange(pool) < wide[live, None])).any(1)
        if k and done.any():
            at = live[done]
            now = dist[at, :k].astype(np.float64).sum(1) if pool >= k else np.zeros(len(at))
            more = (wide[at] < pool) & ((now < last[at]) | ~np.isfinite(now)) & (dist[at, min(pool, k) - 1] >= 0)
            last[at] = now
            wide[at[more]] = np.minimum(2 * wide[at[more]], pool)
            done[done] = ~more
        live = live[~done]
    return np.where(np.isinf(dist), -1, node), dist, looked


def prune_many(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of a row of candidates for each of the nodes ``own``; len(points) stands for none.

    Nearest first, a candidate is kept unless a kept one is closer to it than 1 / ``alpha`` of its distance from the node.
    """
    n = len(points)
    candidates = np.sort(np.where(candidates == own[:, None], n, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    some = points[np.minimum(candidates, n - 1)]
    away = some - points[own][:, None]
    d = np.einsum("ijk,ijk->ij", away, away)
    d[candidates == n] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, candidates, away = (np.take_along_axis(x, order if x.ndim == 2 else order[:, :, None], 1) for x in (d, candidates, away))
    norms = np.einsum("ijk,ijk->ij", away, away)
    among = norms[:, :, None] + norms[:, None] - 2 * away @ away.transpose(0, 2, 1)
    left, kept = np.isfinite(d), np.zeros(d.shape, bool)
    room = np.full(len(own), degree)
    with np.errstate(invalid="ignore"):
        for c in range(d.shape[1]):
            now = left[:, c] & (room > 0)
            if now.any():
                kept[now, c] = True
                room -= now
                left[now] &= alpha * alpha * among[now, c] > d[now]
    out = np.full((len(own), degree), n, np.int32)
    r, c = np.nonzero(kept)
    count = kept.sum(1)
    out[r, np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = candidates[r, c]
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges: a row of nodes for each point, len(points) where there are none; the medoid, where searches start).

    Nodes may have half as many edges more than ``degree`` until they are pruned again, at the end all of them.
    """
    n = len(points)
    points = (points - points.mean(0)).astype(np.float32)  # centred, so that close points differ in many of their digits
    start = int((points**2).sum(1).argmin())
    if n <= degree + 1:
        near = np.arange(n)[None].repeat(n, 0)
        return np.sort(np.where(near == np.arange(n)[:, None], n, near), axis=1)[:, : max(1, n - 1)].astype(np.int32), start
    most = degree + degree // 2
    edges, used = np.full((n, most), n, np.int32), np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, size = 1, 1
    while done < n:  # batches grow with the graph, so that most of a batch's neighbours are in it
        batch = order[done : done + size]
        found, _, _ = beam_search(points, edges, start, points[batch], beam)
        found = np.where(found < 0, n, found)
        if len(batch) > 1:  # a batch's own points are near each other as well, a first few of them
            own = points[batch]
            norms = (own**2).sum(1)
            within = np.argsort(norms[:, None] + norms - 2 * own @ own.T, axis=1)[:, :9]
            found = np.hstack([found, batch[within]])
        kept = prune_many(points, batch, found, degree, alpha)
        edges[batch, :degree], used[batch] = kept, (kept < n).sum(1)
        r, c = np.nonzero(kept < n)
        _add_edges(points, edges, used, kept[r, c], batch[r], degree, alpha)
        done += len(batch)
        size = min(max(size, done // 4), TOGETHER)
    for a in range(0, n, TOGETHER):
        over = a + np.flatnonzero(used[a : a + TOGETHER] > degree)
        if len(over):
            edges[over, :degree] = prune_many(points, over, edges[over], degree, alpha)
    return edges[:, :degree], start


def _add_edges(points: np.ndarray, edges: np.ndarray, used: np.ndarray, source: np.ndarray, target: np.ndarray, degree: int, alpha: float) -> None:
    """Adds edges from ``source`` to ``target`` nodes; a node that has no room is pruned with as many new ones as it has places, again
    and again while some are left."""
    n, most = len(points), edges.shape[1]
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    while len(source):
        first = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        count = np.diff(np.append(first, len(source)))
        nth = np.arange(len(source)) - np.repeat(first, count)
        now = nth < most
        nodes = source[first]
        more = np.full((len(nodes), min(most, int(count.max()))), n, np.int32)
        more[np.repeat(np.arange(len(nodes)), count)[now], nth[now]] = target[now]
        added = (more < n).sum(1)
        fits = used[nodes] + added <= most
        r, c = np.nonzero((more < n) & fits[:, None])
        edges[nodes[r], used[nodes[r]] + c] = more[r, c]
        used[nodes[fits]] += added[fits]
        for a in range(0, int((~fits).sum()), TOGETHER):
            full = np.flatnonzero(~fits)[a : a + TOGETHER]
            kept = prune_many(points, nodes[full], np.hstack([edges[nodes[full]], more[full]]), degree, alpha)
            edges[nodes[full]] = n
            edges[nodes[full], :degree], used[nodes[full]] = kept, (kept < n).sum(1)
        source, target = source[~now], target[~now]


def valid(embedding: F.Column) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    values = embedding.cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(values) > 0) & finite & F.exists(values, lambda x: x != 0), F.lit(False))


INDEX = "shard long, dim int, start int, vec_id binary, embedding binary, node binary, edges binary"


def build_index(vectors: DataFrame, shard: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """The index, a row for each shard of ``vectors`` (vec_id, embedding): its first node, and as arrays the ids and vectors in
    ascending order, their nodes, and the edges of the nodes. Written to the shared folder."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], INDEX)
    shards = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, -(-n // min(shard, max(1, SHARD_BYTES // (8 * k))))))), F.size("embedding"))
    rows = rows.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(3)), shards))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        points = np.array(table.column("embedding").combine_chunks().flatten()).reshape(len(table), -1)
        distinct, node = np.unique(points, axis=0, return_inverse=True)
        edges, start = build_graph(distinct, degree, beam, alpha)
        row = {"shard": table.column("shard")[0].as_py(), "dim": points.shape[1], "start": start, "vec_id": table.column("vec_id").to_numpy().tobytes(), "embedding": points.tobytes(), "node": node.ravel().astype(np.int32).tobytes(), "edges": edges.tobytes()}
        release()
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("start", pa.int32()), *((c, pa.binary()) for c in ("vec_id", "embedding", "node", "edges"))]))

    return settle(rows.groupBy("dim", "shard").applyInArrow(build, INDEX), "graph")[0]


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM, pool: int = POOL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's (vec_id, embedding) ``k`` nearest found, by Euclidean distance; ties go to the
    smaller vec_id. Rows of the query's own vec_id are left out; vectors of another dimension are not compared.

    Queries are sent to all shards of their dimension in blocks of at most QUERY_BYTES, a job each; a shard's graph is read as one row.
    """
    spark = index.sparkSession
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")).where(F.col("query_id").isNotNull() & valid(F.col("query"))).distinct().withColumn("dim", F.size("query"))
    sizes = {r.dim: r.n for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    fields = "query_id long, vec_id long, score double, looked long, nodes long"
    met = spark.createDataFrame([], fields)
    for dim, n in sorted(sizes.items()):
        # half a block each on average: hashes deal them out unevenly
        blocks = max(1, -(-n * dim * 8 * 2 // QUERY_BYTES)) if n * dim * 8 > QUERY_BYTES else 1
        for b in range(blocks):
            some = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)) == b)).toArrow()
            if not len(some):
                continue
            sent = spark.sparkContext.broadcast((some.column("query_id").to_numpy(), np.array(some.column("query").combine_chunks().flatten()).reshape(len(some), dim)))
            found = index.where(F.col("dim") == dim).mapInArrow(_look(sent, k, beam, pool), fields)
            met = met.unionByName(found if blocks == 1 and len(sizes) == 1 else settle(found, "nearest")[0])
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _look(sent, k: int, beam: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids, vectors = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in ("start", "dim", "vec_id", "embedding", "node", "edges")}
                ids, node = np.frombuffer(x["vec_id"], np.int64), np.frombuffer(x["node"], np.int32)
                points = np.frombuffer(x["embedding"], np.float64).reshape(len(ids), x["dim"])
                order = np.argsort(node, kind="stable")  # of a node's members, the smallest id first
                bounds = np.searchsorted(node[order], np.arange(node.max() + 2))
                own = order[bounds[:-1]]
                edges = np.frombuffer(x["edges"], np.int32).reshape(len(own), -1)
                centre = points[own].mean(0)
                near = (points[own] - centre).astype(np.float32)
                for a in range(0, len(vectors), TOGETHER):
                    some, names = vectors[a : a + TOGETHER], asked_ids[a : a + TOGETHER]
                    found, _, looked = beam_search(near, edges, x["start"], (some - centre).astype(np.float32), min(max(beam, k + 1), len(own)), min(pool, len(own)), min(k + 1, len(own)))
                    r, c = np.nonzero(found >= 0)
                    n = found[r, c]
                    score = np.sqrt(((points[own[n]] - some[r]) ** 2).sum(1))
                    # of equal vectors, only the k smallest ids besides the query's own can be among the k nearest
                    each = np.minimum(bounds[n + 1] - bounds[n], k + 1)
                    member = order[np.repeat(bounds[n] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                    r, score = np.repeat(r, each), np.repeat(score, each)
                    other = ids[member] != names[r]
                    r, score, v = r[other], score[other], ids[member][other]
                    by = np.lexsort((v, score, r))
                    r, score, v = r[by], score[by], v[by]
                    first = np.searchsorted(r, np.arange(len(some)))
                    keep = np.arange(len(r)) - first[r] < k
                    yield pa.RecordBatch.from_arrays([pa.array(names[r[keep]]), pa.array(v[keep]), pa.array(score[keep]), pa.array(looked[r[keep]]), pa.array(np.full(int(keep.sum()), len(own)))], names=["query_id", "vec_id", "score", "looked", "nodes"])
        release()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """build_index() and search(). Nulls, empty or zero vectors and ones with null or non-finite components take no part, on either
    side; so do rows without a vec_id. Rows that share a vec_id and vector count once. An empty table gives no rows; other columns
    are ignored, whatever their names."""
    return search(build_index(vectors), queries, k)
