"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes: principal axes of a bounded sample, turned by rotations that iterative quantisation learns (Gong et al., 2013), a bit a
coordinate; several rotations give longer codes than there are dimensions. Index: codes are cut into substrings, each with a table of
its values. Probing: two codes within Hamming distance r agree in some substring up to r // substrings (pigeonhole), so probing
those values of every table finds every code within r; the whole distance then decides, and floats rank what is left. The radius
comes from the sample. A query that finds fewer than k codes within it is searched again with a larger one, up to all codes. How much
probing leaves out depends on the data: where neighbours differ in two bits of five, as among vectors without groups, nearly all
values of a substring lie within its share of the radius, and the test of whole codes does the sorting out.

Queries meet rows in blocks: each task indexes one block of rows and serves one block of queries, so memory is bounded by the block
sizes, and only the best k of each block are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, ROTATIONS, SUBSTRING, ROUNDS, SEED = 8000, 4, 16, 25, 11
ROW_BLOCK, QUERY_BLOCK = 8192, 2048
#: Share of the sample's true neighbours that the radius takes in.
COVER = 0.99


@dataclass
class Codes:
    mean: np.ndarray
    turns: np.ndarray  # dimensions x bits
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substring values of each row's code: rows x substrings, of uint16."""
        if not len(x):
            return np.zeros((0, max(1, -(-self.turns.shape[1] // SUBSTRING))), np.uint16)
        return np.ascontiguousarray(np.packbits((x - self.mean) @ self.turns > 0, axis=1)).view(np.uint16)


def learn(x: np.ndarray, k: int) -> Codes:
    """Codes from sample rows: ROTATIONS learned rotations of all principal axes, padded to whole substrings."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    mean = x.mean(0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    v = (x - mean) @ axes
    turns = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        turns.append(axes @ r)
    all_ = np.concatenate(turns, 1)
    all_ = np.pad(all_, ((0, 0), (0, -all_.shape[1] % SUBSTRING)))
    codes = Codes(mean, all_, 0)
    held = codes.encode(x)
    some = np.arange(0, len(x), max(1, len(x) // 256))
    nearest = x[some] @ x.T
    nearest[np.arange(len(some)), some] = -np.inf
    top = np.argsort(-nearest, axis=1)[:, : max(1, min(k, len(x) - 1))]
    far = [np.bitwise_count(held[i] ^ held[t]).sum(1) for i, t in zip(some, top, strict=True)]
    codes.radius = int(np.quantile(np.concatenate(far), COVER, method="higher")) if len(x) > 1 else all_.shape[1]
    return codes


class Index:
    """One table a substring: rows in the order of their values, and where each value begins."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, starts = np.unique(codes[order, s], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within `radius` of `code`: probe each table's values, then test whole codes."""
        probe = radius // self.codes.shape[1]
        found = np.zeros(len(self.codes), bool)
        for s, (order, values, starts) in enumerate(self.tables):
            near = np.bitwise_count(values ^ code[s]) <= probe
            found[order[np.repeat(near, np.diff(starts))]] = True
            if found.all():
                break
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]


def valid_vectors(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that are null, empty, zero or hold null or non-finite components."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision) of the k rows nearest to each query, itself left out.

    Both tables have (id, vector). Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part;
    queries are compared with rows of their own dimension. Ties go to the smaller id; repeated rows are candidates once for each id and
    vector, and an id with several vectors is asked and found with each. With fewer than k candidates all are returned; with none, no
    rows. Other columns are ignored, whatever their names. Codes are learned for the commonest dimension, from about SAMPLE rows; the few
    rows of any other are compared by floats alone.
    """
    spark = rows.sparkSession
    data = valid_vectors(rows, id_, vector).filter("vec_id is not null").distinct().withColumn("d", F.size("v"))
    asked = valid_vectors(queries, id_, vector).filter("vec_id is not null").distinct().withColumn("d", F.size("v"))
    kinds = data.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = kinds[0]["d"], kinds[0]["n"]
    n_queries = asked.count()
    dice = F.pmod(F.xxhash64("vec_id", F.lit("ann sample")), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)
    drawn = data.filter((F.col("d") == d) & dice).orderBy("vec_id").limit(2 * SAMPLE).select("v").toPandas()
    x = np.array([np.asarray(r) for r in drawn["v"]]) if len(drawn) else np.eye(d)
    codes = learn(x, k)
    shared = spark.sparkContext.broadcast((codes.mean, codes.turns, codes.radius))
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    left = data.withColumns({"row_block": F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)), "query_block": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    right = asked.withColumns({"query_block": F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"), "row_block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))})

    def serve(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        codes = Codes(*shared.value)
        ids, x, q = own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy()), np.stack(asking["v"].to_numpy())
        coded = x.shape[1] == len(codes.mean)
        index = Index(codes.encode(x)) if coded else None
        bits = 16 * index.codes.shape[1] if coded else 0
        out = []
        for query, vector_, code in zip(asking["vec_id"], q, codes.encode(q) if coded else q, strict=True):
            radius = codes.radius
            near = index.within(code, radius) if coded else np.arange(len(ids))
            while coded and len(near) < min(k + 1, len(ids)) and radius < bits:
                radius = min(bits, radius + 16)
                near = index.within(code, radius)
            near = near[ids[near] != query]
            scores = (x[near] * vector_).sum(1)  # summed alike for each row, so equal vectors tie
            best = np.lexsort((ids[near], -scores))[:k]
            out.append((np.full(len(best), query), ids[near[best]], scores[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = ["d", "row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(serve, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, rank, row) by the definition, for measuring recall."""
    for q in query_ids:
        scores = (x * x[np.flatnonzero(ids == q)[0]]).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        yield from ((int(q), rank, int(ids[i])) for rank, i in enumerate(order, 1))
