"""Approximate nearest neighbours by balanced posting lists.

A bounded sample gives balanced centroids and a neighbour graph over them; both fit any task (their sizes are
parameters). Every vector goes to the lists of its nearest centroids, boundary vectors to several. A query walks the
graph, and the ratio of a centroid's distance to the nearest one's selects its lists. Lists and queries meet in one
shuffle, long lists and crowded ones in several tasks, and the scores are exact cosines of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.session import materialize, read_table


@dataclass
class Index:
    """centroids (unit rows), graph (neighbours of each), sizes (vectors of each list); postings: list, vec_id, vec."""

    centroids: np.ndarray
    graph: np.ndarray
    sizes: np.ndarray
    postings: DataFrame


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", length: int | None = None) -> DataFrame:
    """``vec_id, vec`` of the vectors that take part: not null, not zero, all components finite, with an id, and of
    ``length`` components (by default the most frequent length, the smallest of equally frequent ones)."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)  # null or NaN if any component is
    v = v.where((norm > 0) & (norm < float("inf")) & ~F.isnan(norm))
    if length is not None:
        return v.where(F.size("vec") == length)
    lengths = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means whose clusters of over twice the mean size are split and of under a quarter are dropped."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)]
    for step in range(rounds):
        own = np.concatenate([(x[at : at + 2048] @ c.T).argmax(axis=1) for at in range(0, len(x), 2048)])
        size = np.bincount(own, minlength=len(c))
        means = np.zeros_like(c)
        np.add.at(means, own, x)
        length = np.sqrt((means * means).sum(axis=1))
        keep = (size > 0.25 * len(x) / k) & (length > 1e-12)
        c = means[keep] / length[keep, None]
        if step < rounds - 1:
            big = [np.flatnonzero(own == j) for j in np.argsort(-size)[: max(0, k - len(c))] if size[j] > 1]
            c = np.concatenate([c, *[x[rng.choice(m, 1)] for m in big]]) if big else c
    return np.unique(c, axis=0) if len(c) else x[:1]


def neighbour_graph(c: np.ndarray, degree: int, seed: int = 5) -> np.ndarray:
    """The ``degree`` nearest others of each centroid, a ring through all, so that every centroid is reached, and two
    links to anywhere."""
    n = len(c)
    near = np.zeros((n, min(degree, max(1, n - 1))), np.int64)
    for at in range(0, n, 1024):
        like = c[at : at + 1024] @ c.T
        like[np.arange(len(like)), at + np.arange(len(like))] = -np.inf
        near[at : at + 1024] = np.argsort(-like, axis=1, kind="stable")[:, : near.shape[1]]
    ring = (np.arange(n)[:, None] + [1, n - 1]) % n
    return np.concatenate([near, ring, np.random.default_rng(seed).integers(0, n, (n, 2))], axis=1)


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int, pivots: int = 64, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search, all queries of a block in step. It begins at the nearest of ``pivots`` centroids, opens the
    ``wide`` nearest unopened ones of each query at once, and ends where its ``beam`` nearest are all opened. Returns
    these and their squared distances, nearest first (missing ones: infinite)."""
    n, k = len(q), len(c)
    beam = min(beam, k)
    entry = np.unique(np.linspace(0, k - 1, min(k, pivots)).astype(np.int64))
    dist = 2 - 2 * (q @ c[entry].T)
    first = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, d = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf)
    ids[:, : first.shape[1]], d[:, : first.shape[1]] = entry[first], np.take_along_axis(dist, first, 1)
    opened, seen = np.zeros((n, beam), bool), np.zeros((n, k), bool)
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        todo = np.where(opened[live], np.inf, d[live])
        pick = np.argpartition(todo, min(wide, beam) - 1, axis=1)[:, :wide]
        ok = np.isfinite(np.take_along_axis(todo, pick, 1))
        on = ok.any(axis=1)
        live, pick, ok = live[on], pick[on], ok[on]
        if not len(live):
            break
        row, col = np.nonzero(ok)
        row, at = live[row], pick[row, col]
        opened[row, at] = True
        to = graph[ids[row, at]]
        row, to = np.repeat(row, to.shape[1]), to.reshape(-1)
        new = np.flatnonzero(~seen[row, to])
        key = np.unique(row[new] * k + to[new])
        row, to = key // k, key % k
        seen[row, to] = True
        far = np.empty(len(to))
        for s in range(0, len(to), 1 << 16):
            far[s : s + (1 << 16)] = 2 - 2 * np.einsum("nd,nd->n", q[row[s : s + (1 << 16)]], c[to[s : s + (1 << 16)]])
        # merge into the beams
        count = np.bincount(row, minlength=n)[live]
        width = int(count.max(initial=0))
        if not width:
            continue
        more_ids, more_d = np.full((len(live), width), -1, np.int64), np.full((len(live), width), np.inf)
        of, place = np.searchsorted(live, row), np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more_ids[of, place], more_d[of, place] = to, far
        all_ids, all_d = np.concatenate([ids[live], more_ids], axis=1), np.concatenate([d[live], more_d], axis=1)
        all_open = np.concatenate([opened[live], np.zeros(more_d.shape, bool)], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[live], d[live], opened[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_d, all_open))
    order = np.lexsort((ids, d), axis=1)
    return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(d, order, 1), 0)


def build_index(vectors: DataFrame, sample_rows: int = 32_768, per_list: int = 8, max_lists: int = 4096, degree: int = 24, copies: int = 4, boundary: float = 1.2) -> Index | None:
    """Index every vector of ``vectors`` (from clean_vectors). The centroids, one for ``per_list`` vectors of the
    sample and ``max_lists`` at most, are fitted on at most ``sample_rows`` vectors, chosen by a hash of the id. A
    vector is put on the lists whose centroids are at most ``boundary`` times as far as its nearest, ``copies`` at
    most. None for an empty table."""
    sample = vectors.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").toArrow().column("vec")
    if not len(sample):
        return None
    sample = _matrix(sample)
    c = balanced_centroids(sample, min(max_lists, max(1, len(sample) // per_list)), rounds=5)
    graph = neighbour_graph(c, degree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                order, dist = walk(_unit(_matrix(part.column("vec"))), c, graph, copies * 4)
                take = np.sqrt(dist) <= boundary * np.sqrt(dist[:, :1]) + 1e-9
                take[:, copies:] = False
                r, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(order[r, j].astype(np.int32)), part.column("vec_id").take(pa.array(r)), part.column("vec").take(pa.array(r))], ["list", "vec_id", "vec"])

    postings = materialize(vectors.select("vec_id", "vec").mapInArrow(assign, "list int, vec_id long, vec array<double>"), "postings")
    sizes = np.zeros(len(c), np.int64)
    for row in postings.groupBy("list").count().collect():  # at most max_lists rows
        sizes[row[0]] = row[1]
    return Index(c, graph, sizes, postings)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """``query, vector, cosine`` of the ``top`` nearest of ``v`` to each query and of all as near as the last of them;
    cosines exact, never the query's own id."""
    out = []
    vn, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for at in range(0, len(q), 512):
        sim = (q[at : at + 512] / qn[at : at + 512, None]) @ (v / vn[:, None]).T
        sim[q_ids[at : at + 512, None] == ids[None, :]] = -np.inf
        k = min(top, sim.shape[1])
        floor = np.partition(sim, -k, axis=1)[:, -k]
        r, j = np.nonzero((sim >= floor[:, None] - 1e-9) & (sim > -np.inf))
        out.append((q_ids[at + r], ids[j], (q[at + r] * v[j]).sum(axis=1) / (qn[at + r] * vn[j])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """Each query's first ``top``, each vector once."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])  # copies of a vector have one score, so they are neighbours
    query, vec, score = query[new], vec[new], score[new]
    lead = np.searchsorted(query, query)
    keep = np.arange(len(query)) - lead < top
    return query[keep], vec[keep], score[keep]


def search(index: Index, queries: DataFrame, top: int = 5, ratio: float = 1.8, share: float = 1 / 13, least: int = 128, list_rows: int = 8192, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` largest cosines found for each row of ``queries`` (vec_id, vec).
    A query reads those of its nearest lists (``share`` of all, but ``least``) whose centroids are at most ``ratio``
    times as far as its nearest one, and more of them, nearest first, while they hold fewer than ``least`` vectors.
    Lists are dealt out in parts of about ``list_rows`` vectors, crowded lists to several tasks of about ``block``
    queries; short lists share a task."""
    c, graph, sizes = index.centroids, index.graph, index.sizes
    beam = max(least, math.ceil(len(c) * share))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                order, dist = walk(_unit(_matrix(part.column("vec"))), c, graph, beam)
                held = np.where(order >= 0, sizes[order], 0)
                have = np.cumsum(held, axis=1) - held
                take = ((np.sqrt(dist) <= ratio * np.sqrt(dist[:, :1]) + 1e-9) | (have < least)) & (held > 0)
                r, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(order[r, j].astype(np.int32)), part.column("vec_id").take(pa.array(r)), part.column("vec").take(pa.array(r))], ["list", "query_id", "q"])

    routed = materialize(queries.select("vec_id", "vec").mapInArrow(route, "list int, query_id long, q array<double>"), "routes")
    asked = np.zeros(len(c), np.int64)
    for row in routed.groupBy("list").count().collect():
        asked[row[0]] = row[1]
    parts, blocks = np.maximum(1, -(-sizes // list_rows)), np.maximum(1, -(-asked // block))
    n_parts, n_blocks = (F.element_at(F.array(*[F.lit(int(x)) for x in a]), F.col("list") + 1) if a.max() > 1 else F.lit(1) for a in (parts, blocks))
    shelves = max(1, int((sizes * blocks + asked * parts).sum()) // list_rows)
    shelf = F.pmod(F.xxhash64("list", "part", "block"), F.lit(shelves)).cast("int")
    p = index.postings.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn("shelf", shelf)
    q = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), n_blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).withColumn("shelf", shelf)

    def units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Row order by list, part and block; the keys in that order."""
        key = (table.column("list").to_numpy().astype(np.int64) << 40) | (table.column("part").to_numpy().astype(np.int64) << 20) | table.column("block").to_numpy()
        order = np.argsort(key, kind="stable")
        return order, key[order]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            (lo, lk), (ro, rk) = units(left), units(right)
            ids, v, q_ids, q_vec = left.column("vec_id").to_numpy()[lo], _matrix(left.column("vec"))[lo], right.column("query_id").to_numpy()[ro], _matrix(right.column("q"))[ro]
            for key in np.intersect1d(lk, rk).tolist():
                a, b = np.searchsorted(lk, [key, key + 1])
                x, y = np.searchsorted(rk, [key, key + 1])
                found.append(_best(q_ids[x:y], q_vec[x:y], ids[a:b], v[a:b], top))
        out = _top(*(np.concatenate(x) for x in zip(*found, strict=True)), top)
        return pa.table([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    near = p.groupBy("shelf").cogroup(q.groupBy("shelf")).applyInArrow(meet, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """The nearest of all ``vectors`` for each row of ``queries``, by cosine in double precision; see search().

    Null, zero and non-finite vectors take no part on either side, nor do those of an odd length; a query never finds
    its own id. Fewer candidates than ``top``: all of them. Of equal vectors only the ``top + 1`` with the smallest
    ids are indexed, which is all that any result can hold (ties go to the smaller id). Empty tables give an empty
    result; other columns don't matter.
    """
    v = clean_vectors(vectors, id_col, vec_col)
    same = Window.partitionBy("vec").orderBy("vec_id")
    v = materialize(v.distinct().withColumn("k", F.row_number().over(same)).where(F.col("k") <= top + 1).select("vec_id", "vec"), "vectors")
    index = build_index(v)
    if index is None:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, clean_vectors(queries, id_col, vec_col, index.centroids.shape[1]).distinct(), top, **how)


def op4_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = None  # cosines of other engines differ in the last bits; tests compare with brute force
