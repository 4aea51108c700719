"""Exact top-k by inner product: a ball tree in every shard, searched by branch and bound for a block of queries at once.

Vectors are dealt to shards of about SHARD rows, queries to blocks of about QUERIES rows; a task searches one shard for one block. At
a node the bound of a query is q . centre + |q| * radius; a subtree is entered only by the queries whose bound isn't below their current
k-th score, the child with the larger bounds first. The k-th score is shared: every block first searches one shard, and what it
finds is the starting k-th score of that block in all the other shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD, QUERIES, LEAF = 8192, 1024, 64
LOWEST = np.iinfo(np.int64).min


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: tuple[Node, Node] | None = None


def ball_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Split along the line between two far points until LEAF rows or one place remain."""
    rows = np.arange(len(x)) if rows is None else rows
    points = x[rows]
    centre = points.mean(0)
    away = ((points - centre) ** 2).sum(1)
    node = Node(rows, centre, float(np.sqrt(away.max())))
    if len(rows) > LEAF and node.radius > 0:
        a = points[away.argmax()]
        b = points[((points - a) ** 2).sum(1).argmax()]
        order = np.argsort(points @ (b - a), kind="stable")
        half = len(rows) // 2
        node.children = ball_tree(x, rows[order[:half]]), ball_tree(x, rows[order[half:]])
    return node


class Search:
    """Best k of a shard for a block of queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
        self.x, self.ids, self.q, self.query_ids, self.k = x, ids, q, query_ids, k
        self.points, self.lengths = x.astype(float), np.sqrt((q.astype(float) ** 2).sum(1))
        self.wide = float(np.abs(self.points).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) >= 2.0**53
        self.scores = np.full((len(q), k), LOWEST)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor = floor.copy()  # the k-th score so far, here or elsewhere
        self.entered = 0

    def bounds(self, node: Node, active: np.ndarray) -> np.ndarray:
        value = self.q[active].astype(float) @ node.centre + self.lengths[active] * node.radius
        return value + 1e-9 * np.abs(value) + 1e-3

    def visit(self, node: Node, active: np.ndarray) -> None:
        active = active[self.bounds(node, active) >= self.floor[active]]
        if not len(active):
            return
        self.entered += len(active)
        if node.children is None:
            return self.scan(node.rows, active)
        first, second = node.children
        if self.bounds(first, active).sum() < self.bounds(second, active).sum():
            first, second = second, first
        self.visit(first, active)
        self.visit(second, active)

    def scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        for begin in range(0, len(rows), 1024):  # a leaf of equal points can be large
            part = rows[begin : begin + 1024]
            if self.wide:
                scores = self.q[active] @ self.x[part].T
            else:
                scores = (self.q[active].astype(float) @ self.points[part].T).astype(np.int64)
            own = self.query_ids[active][:, None] == self.ids[part][None, :]
            scores[own] = LOWEST
            some = np.flatnonzero((scores >= self.floor[active][:, None]).any(1))
            if not len(some):
                continue
            at = active[some]
            merged = np.concatenate((self.scores[at], scores[some]), 1)
            ids = np.concatenate((self.found[at], np.where(own[some], np.iinfo(np.int64).max, self.ids[part][None, :])), 1)
            best = np.lexsort((ids, -np.maximum(merged, LOWEST + 1)), axis=1)[:, : self.k]
            self.scores[at] = np.take_along_axis(merged, best, 1)
            self.found[at] = np.take_along_axis(ids, best, 1)
            self.floor[at] = np.maximum(self.floor[at], self.scores[at, -1])

    def run(self) -> Search:
        self.visit(ball_tree(self.points), np.arange(len(self.q)))
        return self


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.floor(256.0 * np.array(column.tolist(), float))
    return np.clip(x, -(2.0**62), 2.0**62).astype(np.int64).reshape(len(column), -1)


def _searcher(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(vectors) or not len(queries):
            return pd.DataFrame(columns=columns).astype("int64")
        s = Search(_matrix(vectors["v"]), vectors["vec_id"].to_numpy(), _matrix(queries["v"]), queries["query_id"].to_numpy(), queries["floor"].to_numpy(), k).run()
        real = s.found != np.iinfo(np.int64).max
        return pd.DataFrame({"query_id": np.repeat(s.query_ids, real.sum(1)), "vec_id": s.found[real], "score": s.scores[real]})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query, ties to the smaller vec_id.

    Both inputs have vec_id and embedding; a component x counts as floor(256 * x) (at most 2 ** 62). Rows with a null id, a null, empty or
    non-finite vector take no part; a query meets all vectors of its own length but those of its own id. Of a query id's rows
    only the smallest vector asks; every row of vectors counts, so one of repeated ids can be found more than once. With no vectors or queries the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame, name: str) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        df = df.select(F.col("vec_id").cast("long").alias(name), v.alias("v")).where(f"{name} is not null and size(v) > 0")
        return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).withColumn("dim", F.size("v"))

    vectors, queries = usable(vectors, "vec_id"), usable(queries, "query_id").groupBy("query_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = vectors.count()
    shards = max(1, -(-n // SHARD))
    blocks = max(1, -(-queries.count() // QUERIES))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    dealt = vectors.withColumn("shard", deal("vec_id", shards))
    asked = queries.withColumn("block", deal("query_id", blocks))
    pilot_of = F.pmod(F.col("block"), F.lit(shards)).cast("int")

    by = ["dim", "shard", "block"]
    schema = "query_id long, vec_id long, score long"
    # a block's own shard first
    pilot_vectors = dealt.withColumn("block", F.explode(F.sequence(F.col("shard"), F.lit(max(shards, blocks) - 1), F.lit(shards)))).where(F.col("block") < blocks)
    pilot = pilot_vectors.groupBy(*by).cogroup(asked.withColumn("shard", pilot_of).withColumn("floor", F.lit(LOWEST)).groupBy(*by)).applyInPandas(_searcher(k), schema)
    pilot = common.written(pilot, "pilot")
    kth = pilot.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", F.col("least").alias("floor"))
    known = asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
    known = common.written(known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != pilot_of), "queries")
    others = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("shard") != pilot_of)
    rest = others.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(_searcher(k), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pilot.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.dim = v.dim AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
