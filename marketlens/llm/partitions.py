"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample (``SAMPLE`` vectors, the least by a hash of their id): tasks find each sample vector's
neighbours in the sample; the neighbour graph is halved again and again along its smoothest vector, so that all parts
have equal sizes and few edges are cut; a small classifier (one hidden layer) learns from a vector the parts in which
its neighbours lie. Only the sample, its graph and the classifier pass through the driver, and their sizes are fixed.

Indexing: every vector goes to its most probable part. Searching: a query is routed to its most probable parts, as many
as hold ``COVER`` percent of the neighbours of the sample's vectors. Routed queries and vectors meet in cells of at most
about ``CELL`` rows of each kind, where distances are measured in double precision; a query's best of all cells are
ranked. Parts may have any size: a large part has more cells. A query that finds fewer than ``k`` is searched again in
all cells. The number of parts follows the table's size, from one for up to ``SMALL`` vectors each.

Equal vectors are told apart by id only: no more than the k + 1 least ids of each are compared, which loses nothing.
Vectors that are null, zero, or hold null or non-finite components, rows with a null id, and vectors whose length is
not the most frequent one take no part. Rows that repeat an id count once (the least vector). An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.store import written

SAMPLE = 8192
NEIGHBOURS = 10
COVER = 98
#: Vectors to a part in small and in large tables, the parts from which on the latter holds, and the most parts.
SMALL, PART = 64, 4096
FEWEST, MOST = 16, 256
HIDDEN = 96
CELL = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>): one row for each id that takes part."""
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = "not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)"
    read = read.where("vec_id is not null and vector is not null").where(fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    read = written(read)
    common = read.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return read.where(F.size("vector") == (common["n"] if common else 0))


def sample_graph(sample: np.ndarray, spark) -> np.ndarray:
    """The nearest others of each sample vector, found by tasks in blocks of rows."""
    held, n = spark.sparkContext.broadcast(sample), len(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = held.value
        norms = (every**2).sum(1)
        for batch in batches:
            for at in batch["id"]:
                rows = np.arange(at * 256, min(n, at * 256 + 256))
                far = norms[None, :] - 2 * every[rows] @ every.T
                far[np.arange(len(rows)), rows] = np.inf
                yield pd.DataFrame({"row": rows, "near": list(np.argpartition(far, NEIGHBOURS, 1)[:, :NEIGHBOURS])})

    blocks = -(-n // 256)
    found = spark.range(0, blocks, 1, min(blocks, 32)).mapInPandas(run, "row long, near array<long>").collect()
    graph = np.zeros((n, NEIGHBOURS), np.int64)
    for row, near in found:
        graph[row] = near
    held.unpersist()
    return graph


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Labels 0..parts-1 of equal counts (parts: a power of two), few edges between them."""
    n = len(graph)
    label, rng = np.zeros(n, np.int64), np.random.default_rng(11)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    for _ in range(parts.bit_length() - 1):
        inner = label[src] == label[dst]
        a, b = np.concatenate([src[inner], dst[inner]]), np.concatenate([dst[inner], src[inner]])
        degree = np.maximum(1, np.bincount(a, minlength=n)).astype(float)
        size = np.bincount(label).astype(float)
        x = rng.standard_normal(n)
        for _ in range(60):
            # a lazy walk on each part's graph smooths x; its mean is taken out
            x = 0.5 * x + 0.5 * np.bincount(a, x[b], n) / degree
            x -= (np.bincount(label, x) / size)[label]
            x /= np.sqrt(np.bincount(label, x * x) / size)[label] + 1e-300
        order = np.lexsort((x, label))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        label = 2 * label + (place - first[label] >= size[label] // 2)
    return label


class Router:
    """A classifier with one hidden layer: vectors to probabilities of parts."""

    def __init__(self, vectors: np.ndarray, wanted: np.ndarray) -> None:
        rng, (n, d), parts = np.random.default_rng(5), vectors.shape, wanted.shape[1]
        self.mean, self.scale = vectors.mean(0), float(vectors.std()) or 1.0
        x = (vectors - self.mean) / self.scale
        weights = [rng.standard_normal((d, HIDDEN)) / d**0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / HIDDEN**0.5, np.zeros(parts)]
        self.weights = weights
        one, two = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(30):
            order = rng.permutation(n)
            for k in range(0, n, 256):
                rows = order[k : k + 256]
                h = np.maximum(0, x[rows] @ weights[0] + weights[1])
                g = (_softmax(h @ weights[2] + weights[3]) - wanted[rows]) / len(rows)
                gh = (g @ weights[2].T) * (h > 0)
                step += 1
                for w, grad, m, v in zip(weights, (x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0)), one, two, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (vectors - self.mean) / self.scale @ self.weights[0] + self.weights[1])
        return _softmax(h @ self.weights[2] + self.weights[3])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fitted(vectors: DataFrame, count: int) -> tuple[Router, int, int]:
    """The router, the number of parts, and how many of them a query visits."""
    parts = 1 << max(1, min(FEWEST, count // SMALL), min(MOST, count // PART)).bit_length() - 1
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    sample = np.array([r[0] for r in rows])
    graph = sample_graph(sample, vectors.sparkSession)
    label = balanced_parts(graph, parts)
    wanted = np.zeros((len(sample), parts))
    for near in (np.arange(len(sample))[:, None], graph):
        np.add.at(wanted, (np.repeat(np.arange(len(sample)), near.shape[1]), label[near].reshape(-1)), 1.0)
    router = Router(sample, wanted / wanted.sum(1, keepdims=True))
    odds = router(sample)
    home, rank = odds.argmax(1), np.argsort(np.argsort(-odds, 1), 1)
    visits = np.sort(rank[np.arange(len(sample))[:, None], home[graph]].reshape(-1))
    return router, parts, int(visits[min(len(visits) - 1, len(visits) * COVER // 100)]) + 1


def _routed(vectors: DataFrame, router: Router | None, visits: int) -> DataFrame:
    """vec_id, vector, part: a row for each of the ``visits`` most probable parts."""
    if router is None:
        return vectors.select("vec_id", "vector", F.lit(0).alias("part"))
    held = vectors.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(parts=list(np.argsort(-held.value(np.stack(batch["vector"])), 1, kind="stable")[:, :visits].astype(np.int32)))

    return vectors.select("vec_id", "vector").mapInPandas(run, "vec_id long, vector array<double>, parts array<int>").select("vec_id", "vector", F.explode("parts").alias("part"))


def _nearest(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            q, v, ids = np.stack(queries["vector"]), np.stack(rows["vector"]), rows["vec_id"].to_numpy()
            norms = (v**2).sum(1)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                rough = norms[None, :] - 2 * part @ v.T + (part**2).sum(1)[:, None]
                slack = 1e-9 * (norms.max() + (part**2).sum(1))
                most = np.partition(rough, k, 1)[:, k] + slack if rough.shape[1] > k else np.full(len(part), np.inf)
                for i, own in enumerate(queries["vec_id"].iloc[at : at + 256]):
                    some = np.flatnonzero(rough[i] <= most[i])
                    some = some[ids[some] != own]
                    far = np.sqrt(((v[some] - part[i]) ** 2).sum(1))
                    best = np.lexsort((ids[some], far))[:k]
                    out["query_id"] += [own] * len(best)
                    out["vec_id"] += ids[some][best].tolist()
                    out["score"] += far[best].tolist()
        return pd.DataFrame(out)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of vectors for each query: query_id, rank, vec_id, score (Euclidean distance).

    vectors: vec_id, embedding. queries: vec_id of the vectors to search for; a query's own row is no candidate.
    """
    spark = vectors.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = written(usable(vectors))
    asked = held.join(queries.select("vec_id").distinct(), "vec_id")
    # of equal vectors the k + 1 least ids: Spark cuts each task's rows to these before they are shuffled
    same = Window.partitionBy("vector").orderBy("vec_id")
    some = held.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    count = held.count()
    router, parts, visits = fitted(held, count) if count >= 2 * SMALL else (None, 1, 1)
    index = written(_routed(some, router, 1))
    sizes = index.groupBy("part").agg(F.count("*").alias("n"))
    cells = written(sizes.select("part", F.expr(f"1 + n div {CELL}").alias("cells")))  # a row for each part: 256 at most
    index = index.join(F.broadcast(cells), "part").withColumn("cell", F.expr("pmod(xxhash64(vec_id), cells)")).drop("cells")

    def searched(asked: DataFrame, visits: int) -> DataFrame:
        routed = written(_routed(asked, router, visits))
        groups = written(routed.groupBy("part").agg(F.expr(f"1 + count(*) div {CELL}").alias("groups")))
        sent = routed.join(F.broadcast(groups), "part").join(F.broadcast(cells), "part")
        sent = sent.withColumn("asked", F.expr("pmod(xxhash64(vec_id), groups)")).withColumn("cell", F.explode(F.expr("sequence(0L, cells - 1)")))
        there = index.join(F.broadcast(groups), "part").withColumn("asked", F.explode(F.expr("sequence(0L, groups - 1)")))
        keys = ["part", "cell", "asked"]
        sent, there = (x.select(*keys, "vec_id", "vector").repartition(spread, *keys) for x in (sent, there))
        found = sent.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return written(found.withColumn("rank", best).where(F.col("rank") <= k))

    found = searched(asked, visits)
    if visits < parts and count > k:
        full = found.groupBy("query_id").count().where(F.col("count") == k)
        short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
        if not short.isEmpty():
            found = found.join(full, "query_id", "left_semi").unionByName(searched(short, parts))
    return found.select("query_id", "rank", "vec_id", "score")
